"""Keyed row selection that survives hot keys: every step combines inside tasks before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: list[str], order: Column, choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), order).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the smallest `order` value for each key (give a struct to break ties)."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def with_group_minimum(df: DataFrame, key: str, minimum: int = 2) -> DataFrame:
    """Rows of groups with at least `minimum` rows. Only (key, count) is shuffled for the counting; the rows
    meet it in a semi join, which Spark broadcasts or skew-splits."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select(key)
    return df.join(enough, key, "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: Column, within: Column | None = None) -> DataFrame:
    """Existing rows not named by `incoming`, plus the last incoming row of every key. `within` is a condition that all
    incoming rows fulfil, such as their version: existing rows outside it are passed on where they are."""
    fresh = last_per_key(incoming, keys, arrival)
    if within is None:
        return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    inside = F.coalesce(within, F.lit(False))
    left = existing.where(inside).join(fresh.select(*keys), keys, "left_anti")
    return existing.where(~inside).unionByName(left).unionByName(fresh)


def first_by_hash(df: DataFrame, digest: str, position: str, seen: DataFrame | None = None) -> DataFrame:
    """First arrival of each content digest, skipping digests already in `seen`. One pass over `df`; give it
    the digest and what is needed of the row, not the content."""
    fresh = df if seen is None else df.join(seen.select(digest), digest, "left_anti")
    return first_per_key(fresh, [digest], F.col(position))
