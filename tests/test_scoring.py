import numpy as np
import pytest

from talus.operators import catalogue as C, scoring
from talus.plans.queries import searches
from talus.sources.tables import Catalogue

FOLDER = "/root/testdata/sf0.001"


def frames(spark, asked, held):
    queries = spark.createDataFrame([(i, v) for i, v in asked], "query_id long, vector array<double>")
    stored = spark.createDataFrame([(i, v) for i, v in held], "route_id long, embedding array<float>").repartition(4)
    return queries, stored


def brute(asked, held, k):
    out = {}
    for q, x in asked:
        best = {}
        for r, v in held:
            if r is None or v is None or x is None or len(v) != len(x) or not len(v):
                continue
            a, b = np.array(x, float), np.array(v, np.float32).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
            best[r] = max(best.get(r, -np.inf), -np.inf if np.isnan(s) else s)
        out[q] = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
    return out


def top(df, k):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["id"], -np.inf if r["similarity"] is None else r["similarity"]))
    return {q: sorted(v, key=lambda e: (-e[1], e[0]))[:k] for q, v in got.items()}


@pytest.mark.parametrize("sizes", [(2048, 512, 32), (7, 3, 2)])
def test_best_groups_like_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("CHUNK", "QUERIES", "HELD"), sizes):
        monkeypatch.setattr(scoring, name, value)
    rng = np.random.default_rng(4)
    held = [(int(rng.integers(40)), rng.normal(size=5).tolist()) for _ in range(400)]
    held += [(100, [0.0] * 5), (101, [1.0] * 4), (None, [1.0] * 5), (102, None), (103, [])]
    asked = [(i, rng.normal(size=5).tolist()) for i in range(20)] + [(50, [1.0, 2.0, 0.0, 1.0]), (51, [0.0] * 5), (52, None)]
    queries, stored = frames(spark, asked, held)
    for k in (1, 6, 60):
        got, want = top(scoring.best_per_group(queries, stored, "route_id", "embedding", k), k), brute(asked, held, k)
        assert set(got) == {q for q, v in want.items() if v}
        for q, found in got.items():
            assert [r for r, _ in found] == [r for r, _ in want[q]]
            assert np.allclose([s for _, s in found], [s for _, s in want[q]], atol=1e-12)


def test_no_queries_and_no_vectors(spark):
    queries, stored = frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0])])
    assert scoring.best_per_group(queries.limit(0), stored, "route_id", "embedding", 3).count() == 0
    assert scoring.best_per_group(queries, stored.limit(0), "route_id", "embedding", 3).count() == 0
    assert scoring.summary(queries, stored.limit(0), "route_id", "embedding").count() == 0


def test_five_thousand_queries_scan_the_stored_vectors_twice(spark):
    c = Catalogue(spark, FOLDER)
    rng = np.random.default_rng(8)
    dim = len(c.table("embeddings").first()["embedding"])
    vectors = rng.normal(size=(5000, dim))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, vector array<double>")
    found = C.similarity_search(queries, c.image_embeddings, c.images, c.route_image_embeddings, c.route_images, c.routes, c.areas, "v1", top_k=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embedding#") and sum("embeddings.parquet" in f for f in found.inputFiles()) == 1
    scans = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line and "embedding#" in line]
    assert len(scans) == 2
    rows = found.collect()
    assert {r["query_id"] for r in rows} == set(range(5000)) and all(r["rank"] <= 3 for r in rows)
    # a few of them alone give the same
    few = C.similarity_search(queries.where("query_id % 1000 = 7"), c.image_embeddings, c.images, c.route_image_embeddings, c.route_images, c.routes, c.areas, "v1", top_k=3)
    key = lambda r: (r["query_id"], r["rank"], r["route_id"], r["similarity"])
    assert sorted(map(key, few.collect())) == sorted(key(r) for r in rows if r["query_id"] % 1000 == 7)


def test_the_scoped_search_scores_vectors_of_its_subtree_only(spark):
    c = Catalogue(spark, FOLDER)
    scoped = searches._search(c, area_id=2, top_k=20).collect()
    below = {r["id"] for r in __import__("talus.operators.hierarchy", fromlist=["descend"]).descend(c.areas, 2).collect()}
    homes = {r["id"]: r["area_id"] for r in c.routes.select("id", "area_id").collect()}
    assert scoped and all(homes[r["route_id"]] in below for r in scoped)
