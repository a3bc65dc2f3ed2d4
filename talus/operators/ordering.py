"""Exact global order work without a single-task window.

Rows are range-partitioned on (group, order), sorted inside partitions and marked with
`monotonically_increasing_id`, whose high bits are the partition and whose low bits the position in it.
The marked rows are written once, so partition numbers cannot change between the passes that follow. What
crosses partitions is then one small row per (partition, group).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from talus.session import cut, written

PART_BITS = 33  # low bits that hold the position in monotonically_increasing_id


def mark_order(df: DataFrame, order: list, groups: list[str] = ()) -> DataFrame:
    """Add `_seq` (sortable over the whole table) and `_part`, in (groups, order) order."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + [o if isinstance(o, Column) else F.col(o) for o in order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = cut(ordered.withColumn("_seq", F.monotonically_increasing_id()))
    return marked.withColumn("_part", F.shiftright("_seq", PART_BITS).cast("int"))


def _earlier_parts(value: Column, groups: list[str]):
    window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _join_parts(marked: DataFrame, parts: DataFrame, groups: list[str]) -> DataFrame:
    side = parts
    condition = marked["_part"] == F.col("_p_part")
    side = side.withColumnRenamed("_part", "_p_part")
    for g in groups:
        side = side.withColumnRenamed(g, f"_p_{g}")
        condition = condition & marked[g].eqNullSafe(F.col(f"_p_{g}"))
    return marked.join(side, condition).drop("_p_part", *[f"_p_{g}" for g in groups])


def global_rank(df: DataFrame, order: list, groups: list[str] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based row number over the whole table, or inside each group however large a group is; `total` adds
    the group's row count."""
    groups = list(groups)
    marked = mark_order(df, order, groups)
    parts = marked.groupBy("_part", *groups).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", _earlier_parts(F.col("_n"), groups))
    if total:
        parts = parts.withColumn(total, F.sum("_n").over(Window.partitionBy(*(groups or [F.lit(0)]))))
    parts = parts.drop("_n")
    joined = _join_parts(marked, parts, groups)
    return joined.withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before") + 1).drop(
        "_seq", "_part", "_first", "_before"
    )


def running_before(df: DataFrame, value: str, order: list, groups: list[str] = (), name: str = "before", total: str | None = None) -> DataFrame:
    """Sum of `value` over all rows ordered before this one (0 for the first); `total` adds the whole sum."""
    groups = list(groups)
    marked = mark_order(df, order, groups)
    parts = marked.groupBy("_part", *groups).agg(F.sum(value).alias("_n"))
    parts = parts.withColumn("_before", _earlier_parts(F.col("_n"), groups))
    if total:
        parts = parts.withColumn(total, F.sum("_n").over(Window.partitionBy(*(groups or [F.lit(0)]))))
    parts = parts.drop("_n")
    inside = Window.partitionBy("_part", *groups).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = _join_parts(local, parts, groups)
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_seq", "_part", "_local", "_before")


# --- next-fit packing -------------------------------------------------------------------------------------
#
# A batch is closed when the next group would lift it above the limit. All that a range partition needs to
# know of the ones before it is the fill of the open batch (0..limit; an oversize batch counts as full). Each
# partition therefore reports, for every possible incoming fill, the fill it leaves and how many batches it
# opens. Such a report is a function from fill to fill, and functions of neighbours compose to one for both: reports
# are composed in a tree, FAN at a time, and on the way down every partition gets its true starting state. A last pass
# numbers the batches: the result is exactly that of one sequential scan.

FAN = 64  # reports that one task composes


def _next_starts(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """prefix sums, and for a batch starting at i the index where the following batch starts (the last index, beyond all
    groups, leads to itself)."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    follow = np.searchsorted(prefix[1:], prefix[:-1] + limit, side="right")
    return prefix, np.append(np.maximum(follow, np.arange(len(sizes)) + 1), len(sizes))


def fill_table(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(fill left, batches opened) for each incoming fill 0..limit."""
    rows = len(sizes)
    prefix, follow = _next_starts(sizes, limit)
    # pointer doubling: where 2^k batches lead, how many of them there are, and where the last of them starts
    jump, opened = follow.copy(), np.append(np.ones(rows, dtype=np.int64), 0)
    last = np.arange(rows + 1)
    while (jump < rows).any():
        last = np.where(jump < rows, last[jump], last)
        opened = opened + opened[jump]
        jump = jump[jump]
    left = np.append(np.minimum(prefix[rows] - prefix[last[:rows]], limit), 0)
    fills = np.arange(limit + 1)
    first = np.searchsorted(prefix[1:], limit - fills, side="right")
    first[0] = 0  # an empty batch takes the first group whatever its size
    stays = first == rows
    out = np.where(stays, np.minimum(fills + prefix[rows], limit), left[first])
    return out, np.where(stays, 0, opened[first])


def batch_numbers(sizes: np.ndarray, limit: int, fill: int, base: int) -> np.ndarray:
    """Batch of each group, given the fill of the open batch and how many batches are open before it."""
    rows = len(sizes)
    prefix, follow = _next_starts(sizes, limit)
    start = 0 if fill == 0 else int(np.searchsorted(prefix[1:], limit - fill, side="right"))
    jumps = [follow]
    while (jumps[-1] < rows).any():
        jumps.append(jumps[-1][jumps[-1]])
    # every number of steps from the start is a sum of powers of two
    opens = np.array([start])
    for jump in reversed(jumps):
        opens = np.unique(np.concatenate([opens, jump[opens]]))
    marks = np.zeros(rows + 1, dtype=np.int64)
    marks[opens] = 1
    return base - 1 + np.cumsum(marks[:rows])


def _composed(tables: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The report of several neighbours, given in order, as one."""
    fill, opened = None, None
    for left, more in zip(tables["_left"], tables["_opened"]):
        left, more = np.asarray(left), np.asarray(more)
        fill, opened = (left, more) if fill is None else (left[fill], opened + more[fill])
    return fill, opened


def _starting_states(reports: DataFrame) -> DataFrame:
    """(_epoch, _part, _fill, _base) of reports (_epoch, _part, _left, _opened): what every part starts from. `_part` are
    numbers in the order of the parts, with gaps or without."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, opened = _composed(pdf.sort_values("_part"))
        return pd.DataFrame({"_epoch": pdf["_epoch"].iloc[:1], "_part": pdf["_part"].iloc[:1] // FAN, "_left": [left], "_opened": [opened]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        fill, base = (0, 0) if "_fill" not in pdf else (int(pdf["_fill"].iloc[0]), int(pdf["_base"].iloc[0]))
        fills, bases = [], []
        for left, opened in zip(pdf["_left"], pdf["_opened"]):
            fills.append(fill)
            bases.append(base)
            fill, base = int(left[fill]), base + int(opened[fill])
        return pd.DataFrame({"_epoch": pdf["_epoch"], "_part": pdf["_part"], "_fill": fills, "_base": bases})

    states = "_epoch long, _part int, _fill long, _base long"
    above = F.expr(f"_part div {FAN}").cast("int")
    reports, n = written(reports, "fill-tables", last=F.max("_part"))
    if (n["last"] or 0) < FAN:
        return reports.groupBy("_epoch").applyInPandas(chain, states)
    groups = reports.withColumn("_group", above).groupBy("_epoch", "_group").applyInPandas(compose, "_epoch long, _part int, _left array<long>, _opened array<long>")
    starts = _starting_states(groups).withColumnsRenamed({"_part": "_group"})
    joined = reports.withColumn("_group", above).join(starts, ["_epoch", "_group"])
    return joined.groupBy("_epoch", "_group").applyInPandas(chain, states)


def pack_batches(groups: DataFrame, size: str, order: list, limit: int, epoch: str = "epoch", name: str = "batch") -> DataFrame:
    """Next-fit batches of whole groups, one independent packing per epoch.

    `groups` has one row per group (not per image). Needs `limit` >= 1 and sizes >= 1.
    """
    marked = mark_order(groups, order, [epoch])

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        left, opened = fill_table(pdf["_size"].to_numpy(), limit)
        return pd.DataFrame({"_epoch": [pdf["_epoch"].iloc[0]], "_part": [pdf["_part"].iloc[0]], "_left": [left], "_opened": [opened]})

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        batch = batch_numbers(pdf["_size"].to_numpy(), limit, int(pdf["_fill"].iloc[0]), int(pdf["_base"].iloc[0]))
        return pd.DataFrame({"_seq": pdf["_seq"], name: batch})

    slim = marked.select(F.col(epoch).alias("_epoch"), "_part", "_seq", F.col(size).cast("long").alias("_size"))
    reports = slim.groupBy("_epoch", "_part").applyInPandas(
        report, "_epoch long, _part int, _left array<long>, _opened array<long>"
    )
    numbered = (
        slim.join(_starting_states(reports), ["_epoch", "_part"]).groupBy("_epoch", "_part").applyInPandas(number, f"_seq long, {name} long")
    )
    return marked.join(numbered, "_seq").drop("_seq", "_part")


def batch_estimate(groups: DataFrame, size: str, limit: int) -> DataFrame:
    """Lower bound on the number of batches: max(1, ceil(total / limit))."""
    total = F.coalesce(F.sum(size), F.lit(0))
    return groups.agg(F.greatest(F.lit(1), F.ceil(total / F.lit(limit))).cast("long").alias("batches"))
