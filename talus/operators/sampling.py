"""Seeded sampling. Order is md5(seed | key), so a sample is repeatable on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talus.operators.ordering import global_rank

WORD = 4294967296.0  # 2^32, the range of the eight hex digits taken from a digest


def order_key(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of the digest."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(WORD)


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 42,
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Exactly floor(n * fraction) rows of every stratum get names[0]. Two strata may hold the whole table, so
    ranks come from the distributed ranking, not from one window task per stratum."""
    ranked = global_rank(df.withColumn("_o", order_key(seed, F.col(key))), ["_o", key], [stratum], "_rank", "_size")
    quota = F.floor(F.col("_size") * F.lit(float(fraction)))
    return ranked.withColumn("split", F.when(F.col("_rank") <= quota, names[0]).otherwise(names[1])).drop("_o", "_rank", "_size")


def balanced_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """min(size // 2, class size) rows of each class. The rank filter is applied inside tasks before rows
    move, so a task ships at most size // 2 rows per class."""
    order = Window.partitionBy(stratum).orderBy(order_key(seed, F.col(key)), F.col(key))
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size // 2).drop("_rank")


def bounded_subset(df: DataFrame, key: str, size: int = 2000, seed: int = 42) -> DataFrame:
    return df.orderBy(order_key(seed, F.col(key)), F.col(key)).limit(size)


def weighted_draws(df: DataFrame, positive: str, key: str, seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are rows; a positive row weighs negatives/positives and a
    negative row 1, so both classes are drawn equally often.

    Draw i picks its class from one hash and a rank inside the class from another, then meets the ranked rows
    in an equi-join."""
    ranked = global_rank(df.select(F.col(key), F.col(positive).alias("_pos")), [key], ["_pos"], "_rank")
    sizes = df.agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg")).first()
    pos, neg = sizes["pos"], sizes["neg"]
    u, v = uniform(seed, F.lit("class"), F.col("draw")), uniform(seed, F.lit("row"), F.col("draw"))
    both = pos > 0 and neg > 0
    draws = (
        df.sparkSession.range(1, pos + neg + 1).withColumnRenamed("id", "draw")
        .withColumn("_pos", (u < 0.5) if both else F.lit(pos > 0))
        .withColumn("_rank", (F.floor(v * F.when(F.col("_pos"), pos).otherwise(neg)) + 1).cast("long"))
    )
    return draws.join(ranked, ["_pos", "_rank"]).select("draw", key, F.col("_pos").alias(positive))
