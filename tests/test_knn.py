import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import knn, metrics as M

VECTORS = "id long, vector array<float>"


def random_rows(n, dim=8, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype(np.float32)
    return data, [(i, [float(x) for x in data[i]], int(i % labels)) for i in range(n)]


def brute(data, k):
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    return {(i, int(j), r + 1) for i in range(len(data)) for r, j in enumerate(np.lexsort((np.arange(len(data)), -np.round(sims[i], 12)))[:k])}


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "lists": 6}, {"block_rows": 7, "lists": 2}])
def test_exact_neighbours(spark, options):
    data, rows = random_rows(150)
    df = spark.createDataFrame([r[:2] for r in rows], VECTORS).repartition(5)
    found = knn.nearest(df, df, 4, exclude_self=True, **options).collect()
    assert {(r["query_id"], r["neighbour_id"], r["rank"]) for r in found} == brute(data, 4)


def test_duplicates_never_return_self_and_zero_vectors_are_skipped(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], VECTORS)
    found = {(r["query_id"], r["neighbour_id"]) for r in knn.nearest(df, df, 2, exclude_self=True).collect()}
    assert all(q != n for q, n in found)
    assert (1, 2) in found and (2, 1) in found and not any(3 in pair for pair in found)


def test_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    assert knn.nearest(df.limit(0), df, 2).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_partner_search_equals_brute_force_on_a_hot_label(spark, block):
    data, rows = random_rows(200, labels=2)
    rows = [(i, v, 0 if i < 190 else i) for i, v, _ in rows]  # one hot label and singletons
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(4)
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    sims = unit[:190] @ unit[:190].T
    np.fill_diagonal(sims, -1)
    for threshold in (0.5, 0.85):
        expected = {int(i) for i in np.flatnonzero((sims > threshold).any(axis=1))}
        got = {r["id"] for r in knn.with_partner(df, "label", "id", "vector", threshold, block_rows=block, lists=5).collect()}
        assert got == expected and got


def test_statistics_without_pairs(spark):
    data, rows = random_rows(60, labels=4)
    data = data / np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in data[i]], l) for i, _, l in rows] + [(999, [1.0] * 8, 77)], "id long, vector array<float>, label int")
    v = np.array([r["vector"] for r in df.orderBy("id").collect()], dtype=np.float64)
    labels = [r["label"] for r in df.orderBy("id").collect()]
    per = []
    for l in range(4):
        e = v[[i for i, x in enumerate(labels) if x == l]]
        per.append((2 - 2 * e @ e.T)[np.triu_indices(len(e), 1)].mean())
    assert knn.alignment(df, "label", "vector").first()["alignment"] == pytest.approx(np.mean(per), abs=1e-9)
    d2 = ((v[:, None] - v[None]) ** 2).sum(-1)[np.triu_indices(len(v), 1)]
    assert knn.uniformity(df, "id", "vector", chunk=13).first()["uniformity"] == pytest.approx(np.log(np.exp(-2 * d2).mean()), abs=1e-9)
    assert knn.alignment(df.where("label = 77"), "label", "vector").first()["alignment"] == 0.0


def test_singletons_count_as_misses(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 1)], "id long, vector array<float>, label int")
    out = M.retrieval(df, "id", "label", "vector").first()
    assert out["recall_at_1"] == pytest.approx(2 / 3) and out["mrr"] == pytest.approx(2 / 3)
    assert M.retrieval(df.limit(0), "id", "label", "vector").first()["mrr"] is None


def test_all_cells_probed_is_exact_and_recall_is_usable(spark):
    data, rows = random_rows(300)
    df = spark.createDataFrame([r[:2] for r in rows], VECTORS)
    centroids = knn.build_cells(df, lists=8)
    cells = knn.assign_cells(df, centroids, "vector").cache()
    exact = brute(data, 5)
    everything = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in knn.probe_nearest(df, cells, centroids, 5, probes=8, exclude_self=True, block_rows=50).collect()}
    assert everything == exact
    some = {(r["query_id"], r["neighbour_id"]) for r in knn.probe_nearest(df, cells, centroids, 5, probes=3, exclude_self=True).collect()}
    assert len(some & {e[:2] for e in exact}) / len(exact) > 0.5


RAGGED = [(9001, [1.0, 2.0]), (9002, [0.0] * 8), (9003, None), (9004, []), (9005, [1.0] * 7 + [None])]


@pytest.mark.parametrize("options", [{}, {"block_rows": 11, "lists": 3}, {"lists": 1}, {"block_rows": 3, "lists": 60}])
@pytest.mark.parametrize("n", [1, 3, 120])
def test_rows_of_other_lengths_are_errors_and_change_nothing(spark, options, n):
    data, rows = random_rows(n)
    df = spark.createDataFrame([r[:2] for r in rows] + RAGGED, VECTORS).repartition(3)
    found = knn.nearest(df, df, 4, exclude_self=True, **options).collect()
    assert {(r["query_id"], r["neighbour_id"], r["rank"]) for r in found} == {x for x in brute(data, 4) if x[0] != x[1]}
    usable, errors, dim = knn.by_length(df)
    assert dim == 8 and usable.count() == n
    assert {(r["id"], r["length"], r["reason"]) for r in errors.collect()} == {
        (9001, 2, "length"), (9002, 8, "zero"), (9003, -1, "empty"), (9004, 0, "empty"), (9005, 8, "gap")}


def test_a_hot_cell_of_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(90)] + [(100 + i, [0.0, 1.0, float(i) / 50]) for i in range(10)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = knn.nearest(df, df, 3, exclude_self=True, block_rows=20, lists=5).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"]))
    assert all([n for _, n in sorted(got[i])] == [x for x in range(4) if x != i][:3] for i in range(90))


@pytest.mark.parametrize("block, lists", [(2048, 64), (30, 64), (30, 3), (8, 8)])
def test_partners_when_a_label_holds_a_third_of_the_table(spark, block, lists):
    data, rows = random_rows(360, dim=6, seed=3)
    rows = [(i, v, 0 if i % 3 == 0 else 1 + i % 40) for i, v, _ in rows]
    odd = [(5000, [1.0, 2.0], 0), (5001, [1.0, 2.1], 0), (5002, [0.0] * 6, 0), (5003, None, 0), (5004, [1.0] * 6, None), (5005, [1.0] * 6, None), (5006, [9.0] * 6, 777)]
    df = spark.createDataFrame(rows + odd, "id long, vector array<float>, label int").repartition(5)
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    sims = unit @ unit.T
    label = np.array([r[2] for r in rows])
    sims[(label[:, None] != label[None]) | np.eye(len(rows), dtype=bool)] = -1
    for threshold in (0.4, 0.8, 0.95, 0.99):
        expected = {int(i) for i in np.flatnonzero((sims > threshold).any(axis=1))} | {5000, 5001}
        got = {r["id"] for r in knn.with_partner(df, "label", "id", "vector", threshold, block_rows=block, lists=lists).collect()}
        assert got == expected


def test_no_rows_and_single_rows_have_no_partner(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.0], "y")], "id string, vector array<double>, label string")
    assert knn.with_partner(df, "label", "id", "vector", 0.1).count() == 0
    assert knn.with_partner(df.limit(0), "label", "id", "vector", 0.1).count() == 0
    same = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [1.0, 0.1], "x")], "id string, vector array<double>, label string")
    assert {r["id"] for r in knn.with_partner(same, "label", "id", "vector", 0.1).collect()} == {"a", "b"}


def test_inverted_lists_read_the_probed_partitions_only(spark, tmp_path):
    data, rows = random_rows(400)
    df = spark.createDataFrame([r[:2] for r in rows] + RAGGED, VECTORS)
    index = knn.InvertedLists.build(df, lists=8, path=str(tmp_path / "index"))
    again = knn.InvertedLists.open(spark, str(tmp_path / "index"))
    assert np.allclose(index.centroids, again.centroids)
    exact = brute(data, 5)
    everything = {(r["query_id"], r["neighbour_id"], r["rank"]) for r in again.search(df, 5, probes=8, exclude_self=True, block_rows=50).collect()}
    assert everything == exact
    _, lists = again.probed(df.where("id = 7"), 2)
    assert "dynamicpruning" in lists._jdf.queryExecution().executedPlan().toString()
    assert lists.select("cell").distinct().count() <= 2 and lists.count() < 400
    pairs = spark.createDataFrame([e[:2] for e in exact], "query_id long, neighbour_id long")
    probes = again.probes_for(pairs, 0.9)
    recall = [len({(r["query_id"], r["neighbour_id"]) for r in again.search(df, 5, probes=p, exclude_self=True).collect()} & {e[:2] for e in exact}) / len(exact) for p in (probes - 1, probes)]
    assert recall[0] < 0.9 <= recall[1]


def _sent(monkeypatch):
    """Rows that each side of a cogroup is made of."""
    rows, side = [], knn._side

    def counted(df, prefix):
        rows.append(df.count())
        return side(df, prefix)

    monkeypatch.setattr(knn, "_side", counted)
    return rows


def test_seekers_are_sent_to_few_tiles_however_small_the_blocks(spark, monkeypatch):
    data, rows = random_rows(600, dim=16, seed=4, labels=1)
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(4)
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    sent = _sent(monkeypatch)
    got = {r["id"] for r in knn.with_partner(df, "label", "id", "vector", 0.7, block_rows=8, lists=3).collect()}
    assert got == set(np.flatnonzero((sims > 0.7).any(axis=1)).tolist())
    assert len(sent) == 2 and max(sent) <= 8 * 600


def test_queries_are_sent_to_few_tiles_however_small_the_blocks(spark, monkeypatch, tmp_path):
    data, rows = random_rows(600, dim=16, seed=5)
    df = spark.createDataFrame([r[:2] for r in rows], VECTORS).repartition(4)
    index = knn.InvertedLists.build(df, lists=6, path=str(tmp_path / "index"))
    sent = _sent(monkeypatch)
    for found in (knn.nearest(df, df, 4, exclude_self=True, block_rows=10, lists=20), index.search(df, 4, probes=6, exclude_self=True, block_rows=10)):
        assert {(r["query_id"], r["neighbour_id"], r["rank"]) for r in found.collect()} == brute(data, 4)
    assert sum(sent[0:4:2]) <= 8 * 600 and len(sent) == 6 and sent[4] <= 8 * 600
