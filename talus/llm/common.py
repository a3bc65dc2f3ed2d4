"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from talus.session import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) only, so extra columns cannot clash; a null text is the empty text."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], block: int = 2048) -> DataFrame:
    """mapInArrow with plain tuples on both sides; at most `block` result rows are held at a time."""
    types_ = spark_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for start in range(0, batch.num_rows, block):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, block).columns))

        held: list[tuple] = []
        for row in rows(each()):
            held.append(row)
            if len(held) >= block:
                yield record_batch(held, types_)
                held = []
        if held:
            yield record_batch(held, types_)

    return df.mapInArrow(run, schema)


def spark_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(",")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: a cut that survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker process and kept for its later tasks."""
    held = sys.modules.setdefault("_talus_llm_worker", types.ModuleType("_talus_llm_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def forget() -> None:
    """Let go of what `per_process` keeps for an operator before this one, and of memory that was freed: worker processes go
    from stage to stage of a pipeline."""
    sys.modules.pop("_talus_llm_worker", None)
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts_for(total_bytes: int, spark: SparkSession, each: int = 32 << 20) -> int:
    """Partitions for so many bytes: one per `each` bytes, the session's shuffle setting at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes or 0) // each))
