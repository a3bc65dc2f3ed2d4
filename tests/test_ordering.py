import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from talus.operators import curation as K, ordering as O, sampling


def sequential(sizes, limit, fill=0, base=0):
    """One scan, as a person would pack."""
    out, open_batch = [], base - 1
    if fill == 0:
        open_batch = base - 1
    for n in sizes:
        if fill == 0 or fill + n > limit:
            open_batch, fill = open_batch + 1, 0
        fill += n
        out.append(open_batch)
    return out, fill


@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_parts_chain_to_one_scan(parts, limit):
    whole, _ = sequential([n for p in parts for n in p], limit)
    fill, base, chained = 0, 0, []
    for part in parts:
        sizes = np.array(part)
        chained += list(O.batch_numbers(sizes, limit, fill, base))
        left, opened = O.fill_table(sizes, limit)
        fill, base = int(left[fill]), base + int(opened[fill])
    assert chained == whole


def test_published_packing(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate([2, 2, 3, 7, 1, 4])], "epoch long, route_id long, n long")
    packed = O.pack_batches(rows, "n", ["route_id"], 5).orderBy("route_id").collect()
    assert [r["batch"] for r in packed] == [0, 0, 1, 2, 3, 3]


def test_packing_over_many_partitions(spark):
    rng = random.Random(7)
    sizes = [rng.randint(1, 40) for _ in range(3000)]
    rows = spark.createDataFrame([(e, i, n) for e in range(2) for i, n in enumerate(sizes)], "epoch long, route_id long, n long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = O.pack_batches(rows, "n", ["route_id"], 64).where("epoch = 1").orderBy("route_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["batch"] for r in packed] == sequential(sizes, 64)[0]
    totals = {}
    for r in packed:
        totals.setdefault(r["batch"], []).append(r["n"])
    assert all(sum(v) <= 64 or len(v) == 1 for v in totals.values())


def test_rank_inside_one_hot_group(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.col("id") % 7).alias("g")).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = O.global_rank(rows, [F.col("id").desc()], ["g"], "r", "total").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by_group = {}
    for row in ranked:
        by_group.setdefault(row["g"], []).append((row["r"], row["id"], row["total"]))
    for members in by_group.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1] for m in members] == sorted((m[1] for m in members), reverse=True)
        assert {m[2] for m in members} == {len(members)}


def test_running_sum_equals_scan(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 13).alias("n")).repartition(9)
    out = O.running_before(rows, "n", ["id"]).orderBy("id").collect()
    total = 0
    for r in out:
        assert r["before"] == total
        total += r["n"]


def test_split_is_whole_and_leak_free(spark):
    rows = spark.createDataFrame(
        [(i, f"r{i % 37}", "ab"[i % 2] + "/" + str(i % 37)) for i in range(500)], "idx long, route_id string, area_path string")
    groups = K.route_groups(rows)
    split = K.contiguous_split(groups, 0.8, 0.1)
    assert split.count() == groups.count() == split.select("route_id").distinct().count()
    sizes = {r["split"]: r["s"] for r in split.groupBy("split").agg(F.sum("n").alias("s")).collect()}
    assert sum(sizes.values()) == 500 and sizes["train"] >= 400


def test_depth_first_order_differs_from_text_order(spark):
    rows = spark.createDataFrame([(0, 1, "x", 1), (1, 2, "x-y", 1), (2, 3, "x/z", 1)], "first_idx long, route_id long, area_path string, n long")
    plain = K.contiguous_split(rows, 0.0, 0.7).where("split = 'val'").select("area_path").orderBy("before").collect()
    dfs = K.contiguous_split(rows, 0.0, 0.7, true_dfs=True).where("split = 'val'").select("area_path").orderBy("before").collect()
    assert [r[0] for r in plain] == ["x", "x-y"]
    assert [r[0] for r in dfs] == ["x", "x/z"]


def test_share_uses_float_arithmetic(spark):
    rows = spark.range(10).select(F.col("id").alias("first_idx"), F.col("id").alias("route_id"), F.lit("a").alias("area_path"), F.lit(1).alias("n"))
    counts = {r["split"]: r["count"] for r in K.contiguous_split(rows, 0.29, 0.57).groupBy("split").count().collect()}
    train, val = int(0.29 * 10), int(0.57 * 10)
    assert counts == {"train": train, "val": val, "test": 10 - train - val}


def test_weighted_draws_are_balanced(spark):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") < 100).alias("keep"))
    draws = sampling.weighted_draws(rows, "keep", "id")
    counts = draws.agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("pos")).first()
    assert counts["n"] == 4000
    assert abs(counts["pos"] / 4000 - 0.5) < 0.05


def test_stratified_split_is_exact(spark):
    rows = spark.range(1001).select(F.col("id"), (F.col("id") % 3 == 0).alias("keep"))
    out = {(r["keep"], r["split"]): r["count"] for r in sampling.stratified_split(rows, "keep", "id", 0.7).groupBy("keep", "split").count().collect()}
    assert out == {(True, "train"): int(334 * 0.7), (True, "test"): 334 - int(334 * 0.7), (False, "train"): int(667 * 0.7), (False, "test"): 667 - int(667 * 0.7)}


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_reports_composed_in_a_tree_give_the_sequential_batches(spark, monkeypatch, fan):
    monkeypatch.setattr(O, "FAN", fan)
    rng = np.random.default_rng(fan)
    rows = [(e, i, int(n)) for e in range(2) for i, n in enumerate(rng.integers(1, 90, 400))]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["epoch"], r["i"]): r["batch"] for r in O.pack_batches(spark.createDataFrame(rows, "epoch long, i long, n long"), "n", ["i"], 64).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for epoch in range(2):
        fill = batch = 0
        for e, i, n in rows:
            if e == epoch:
                if i and fill + n > 64:
                    fill, batch = n, batch + 1
                else:
                    fill += n
                assert got[e, i] == batch
