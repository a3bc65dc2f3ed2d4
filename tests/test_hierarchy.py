import pytest
from pyspark.sql import functions as F

from talus.operators import hierarchy as H
from talus.session import written

AREAS = "id long, parent_id long, name string"


def pairs(df):
    return {(r["ancestor"], r["descendant"], r["depth"]) for r in df.collect()}


def test_cycle_stops_and_orphans_stay_below_their_last_parent(spark):
    areas = spark.createDataFrame(
        [(1, 2, "a"), (2, 1, "b"), (3, 1, "below"), (10, 99, "orphan"), (11, 10, "child"), (20, None, "root"), (21, 20, "leaf")], AREAS)
    lines = H.lineages(areas).cache()
    assert pairs(H.closure(lines)) == {
        (1, 1, 0), (2, 1, 1), (2, 2, 0), (1, 2, 1), (3, 3, 0), (1, 3, 1), (2, 3, 2),
        (10, 10, 0), (11, 11, 0), (10, 11, 1), (20, 20, 0), (21, 21, 0), (20, 21, 1)}
    assert {r["area_path"] for r in H.area_paths(lines).collect()} == {"root", "root/leaf"}
    assert {r["id"] for r in H.subtree(lines, 10).collect()} == {10, 11}


def test_long_chain_and_depth_bound(spark):
    areas = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(150)], AREAS)
    lines = H.lineages(areas)
    deep = H.subtree(lines, 0).agg({"depth": "max", "id": "count"}).first()
    assert deep["max(depth)"] == 149 and deep["count(id)"] == 150
    assert H.subtree(lines, 5, 8).count() == 9
    assert H.area_paths(lines).where("id = 3").first()["area_path"] == "n0/n1/n2/n3"


def test_reachability_visits_once_and_lists_failures(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "gone"), ("x", "y")], "src string, dst string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "url string")
    roots = spark.createDataFrame([("a",), ("missing",)], "url string")
    found, failed = H.reachable(links, roots, pages)
    assert {(r["url"], r["distance"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r["url"], r["distance"]) for r in failed.collect()} == {("missing", 0), ("gone", 2)}


@pytest.mark.parametrize("few", [1 << 17, 3])
def test_links_are_computed_once_and_large_levels_are_not_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(H, "FEW", few)
    calls = spark.sparkContext.accumulator(0)

    def child(page):
        calls.add(1)
        return [2 * page + 1, 2 * page + 2] if page != 3 else [3, None, 0]

    pages = spark.range(40).select(F.col("id").alias("url"))
    links = pages.select(F.col("url").alias("src"), F.explode(F.udf(child, "array<long>")("url")).alias("dst"))
    found, failed = H.reachable(links, spark.createDataFrame([(0,)], "url long"), pages)
    expected = {i: (i + 1).bit_length() - 1 for i in range(81) if i == 0 or (i - 1) // 2 != 3}
    for i in sorted(expected):
        if i and (i - 1) // 2 not in expected:
            del expected[i]
    assert {r["url"]: r["distance"] for r in found.collect()} == {i: d for i, d in expected.items() if i < 40}
    assert sorted((str(r["url"]), r["distance"]) for r in failed.collect()) == sorted([(str(i), d) for i, d in expected.items() if i >= 40] + [("None", 3)])
    assert calls.value <= 40


def brute_closure(rows):
    parent = {i: p for i, p, _ in rows}
    out = set()
    for i in parent:
        chain, at = [], i
        while at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        out |= {(a, i, d) for d, a in enumerate(chain)}
    return out


ODD = [(1, 2, "a"), (2, 1, "b"), (3, 1, "below"), (10, 99, "orphan"), (11, 10, "child"), (20, None, "root"), (21, 20, "leaf"), (22, 20, "twig"),
       (23, 22, "bud"), (30, None, "alone"), (40, 40, "own parent")]


def test_ranges_give_the_closure_of_trees_orphans_and_cycles(spark):
    areas = spark.createDataFrame(ODD, AREAS)
    assert pairs(H.area_pairs(areas)) == brute_closure(ODD)
    assert pairs(H.area_pairs(areas, 1)) == {p for p in brute_closure(ODD) if p[2] <= 1}
    numbered, rest = H.nested_sets(areas)
    got = {r["id"]: (r["pos"], r["size"], r["depth"], r["rooted"]) for r in numbered.collect()}
    assert {r["id"] for r in rest.collect()} == {1, 2, 3, 40}
    assert sorted(p for p, *_ in got.values()) == list(range(7))
    assert got[20][1:] == (4, 0, True) and got[10][1:] == (2, 0, False) and got[23][1:] == (1, 2, True)
    assert H.nested_sets(areas.limit(0))[0].count() == 0 and H.area_pairs(areas.limit(0)).count() == 0


def test_ranges_of_a_long_chain_and_a_wide_node(spark):
    rows = [(i, i - 1 if i else None, "n") for i in range(2000)] + [(5000 + i, 3000 if i else None, "n") for i in range(1, 500)] + [(3000, None, "n")]
    areas = spark.createDataFrame(rows, AREAS)
    numbered, rest = H.nested_sets(areas)
    got = {r["id"]: (r["pos"], r["size"], r["depth"]) for r in numbered.collect()}
    assert rest.isEmpty() and len(got) == 2500
    assert all(got[i] == (i, 2000 - i, i) for i in range(2000))
    assert got[3000] == (2000, 500, 0) and {got[5000 + i][0] for i in range(1, 500)} == set(range(2001, 2500))
    values = areas.select("id", F.lit(3).alias("value"))
    roots = areas.where("id IN (0, 1500, 1995, 3000)").select("id")
    sums = {(r["root"], r["depth"]): r["total"] for r in H.subtree_sums(numbered, roots, values, 8).collect()}
    want = {(r, d): 3 for r in (0, 1500) for d in range(9)} | {(1995, d): 3 for d in range(5)} | {(3000, 0): 3, (3000, 1): 499 * 3}
    assert sums == want
    whole = {r["root"]: r["total"] for r in H.subtree_sums(numbered, roots, values).collect()}
    assert whole == {0: 6000, 1500: 1500, 1995: 15, 3000: 1500}


def test_sums_of_roots_on_cycles(spark):
    areas = spark.createDataFrame(ODD, AREAS)
    values = spark.createDataFrame([(i, 1) for i, *_ in ODD] + [(777, 5)], "id long, value int")
    for bound in (0, 1, 8):
        got = {(r["root"], r["depth"]): r["total"] for r in H.area_sums(areas, areas, values, bound).collect()}
        want = {}
        for a, _, d in brute_closure(ODD):
            if d <= bound:
                want[a, d] = want.get((a, d), 0) + 1
        assert got == want


def test_the_search_below_a_root_writes_its_subtree_only(spark, tmp_path, monkeypatch):
    rows = ODD + [(100 + i, 100 + i // 2 if i else None, "n") for i in range(1, 400)] + [(100, None, "n")]
    areas, made = spark.createDataFrame(rows, AREAS), []
    monkeypatch.setattr(H, "written", lambda df, label, **more: made.append(written(df, label, **more)) or made[-1])
    below = {(d, n) for a, d, n in brute_closure(rows) if a == 100 + 3}
    assert {tuple(r) for r in H.descend(areas, 103).collect()} == below
    assert sum(n["rows"] for _, n in made) == len(below)
    made.clear()
    assert {tuple(r) for r in H.descend(areas, 103, 2).collect()} == {x for x in below if x[1] <= 2}
    assert len(made) == 2  # the root and its children, then one level; deeper ones are not looked at
    assert {tuple(r) for r in H.descend(areas, 1).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert H.descend(areas, 99).count() == 0 and H.descend(areas, 4711).count() == 0 and H.descend(areas, 40).collect()[0][:] == (40, 0)
