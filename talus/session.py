"""Session settings, lineage cuts and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "talus") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a local session may fall back to a private one."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="talus-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Used where a later step must see exactly the same rows again (partition ids, loop state), so a lost
    executor only re-reads files.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The rows as a table in the shared folder, and counts over them (`rows`, and those asked for), in one job. Unlike
    `cut` it keeps columns apart, and Spark knows its size, so small tables are joined without a shuffle."""
    seen, path = Observation(), scratch(df.sparkSession, label)
    aggregates = [F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()]]
    df.observe(seen, *aggregates).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {"rows": 0, **dict.fromkeys(counts, 0), **seen.get}
