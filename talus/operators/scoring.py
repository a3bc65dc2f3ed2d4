"""Stored vectors against a set of query vectors of any size.

Both sides travel as data: stored vectors in chunks, query vectors in blocks, one row each. Every chunk meets every
block in an equality join on a slot (blocks stand in all slots, a chunk in one), which Spark broadcasts where the blocks
are small and shuffles evenly where they are not; the stored side is read once either way. A pair is one matrix product,
and only what can still be in the answer leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talus.functions.vectors import to_matrix, unit_rows
from talus.session import written

CHUNK = 2048   # stored vectors of a chunk
QUERIES = 512  # query vectors of a block
DIGITS = 12    # of a similarity that count
HELD = 32      # blocks whose candidates a task keeps before it lets them go


def _packed(df: DataFrame, id: str, vector: str, rows: int) -> DataFrame:
    """(ids, vectors, dim): runs of at most `rows` vectors of one length, ids and components as bytes. A null vector, and a
    null id, take no part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                own = own[np.argsort(ids[own], kind="stable")]
                for start in range(0, len(own), rows):
                    part = own[start : start + rows]
                    matrix = to_matrix(vectors.take(pa.array(part)), dim)
                    yield pa.RecordBatch.from_pylist(
                        [{"ids": ids[part].astype(np.int64).tobytes(), "vectors": matrix.astype(kind).tobytes(), "dim": dim}], schema=schema)

    schema = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("dim", pa.int32())])
    kind = np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    usable = df.select(F.col(id).cast("long"), vector).where(F.col(id).isNotNull() & (F.size(vector) > 0))
    return usable.mapInArrow(pack, "ids binary, vectors binary, dim int")


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(vectors) == 4 * dim * len(ids) else np.float64
    return ids, unit_rows(np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64))


def _met(queries: DataFrame, stored: DataFrame, id: str, vector: str) -> DataFrame:
    """(block, q_ids, q_vectors, dim, ids, vectors): every pair of a block of queries (query_id, vector) and a chunk of
    stored vectors of the same length."""
    blocks = _packed(queries.select("query_id", "vector"), "query_id", "vector", QUERIES)
    blocks, _ = written(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    slots = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    blocks = blocks.select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "dim", every.alias("slot"))
    # any slot does: a chunk that is made again may take another one
    chunks = _packed(stored, id, vector, CHUNK).withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int"))
    return chunks.join(blocks, ["slot", "dim"]).select("block", "q_ids", "q_vectors", "dim", "ids", "vectors")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, query ids, ids, similarities) of the pairs of a task."""
    block, query_ids, asked = None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            number, q_ids, q_vectors, dim, ids, vectors = (column[i].as_py() for column in batch.columns)
            if number != block:
                block, (query_ids, asked) = number, _unpacked(q_ids, q_vectors, dim)
            ids, units = _unpacked(ids, vectors, dim)
            # one vector stands for several ids now and then: its cosine must not depend on its place in a chunk
            yield block, query_ids, ids, np.round(asked @ units.T, DIGITS)


def best_per_group(queries: DataFrame, stored: DataFrame, id: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, similarity): for each query (query_id, vector) the `k` ids with the best cosine, each with the maximum
    over its vectors, ties by id. An id without a defined cosine (zero vectors) comes last, with null; vectors of another
    length than the query's take no part.

    A task sends at most `k` candidates for each query and flush; an id of the answer has its maximum in some chunk, where
    fewer than `k` ids can stand before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def let_go() -> Iterator[pa.RecordBatch]:
            for query, group, value in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(group), pa.array(value, mask=np.isneginf(value))], names=["query_id", "id", "similarity"])
            held.clear()

        for block, query_ids, ids, sims in _pairs(batches):
            starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # a chunk is sorted by id
            best = np.maximum.reduceat(np.nan_to_num(sims, nan=-np.inf), starts, axis=1)
            groups = ids[starts]
            rows, cols = _first(best, k)
            found = (query_ids[rows], groups[cols], best[rows, cols])
            if block in held:
                found = _merged(*(np.concatenate(pair) for pair in zip(held[block], found)), k)
            elif len(held) >= HELD:
                yield from let_go()
            held[block] = found
        yield from let_go()

    candidates = _met(queries, stored, id, vector).mapInArrow(run, "query_id long, id long, similarity double")
    best = candidates.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    return best


def _first(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the `k` largest of every row; of equal ones the first columns."""
    width = values.shape[1]
    if width > k:
        least = np.partition(values, width - k, axis=1)[:, [width - k]]
        rows, cols = np.nonzero(values >= least)
    else:
        rows, cols = np.nonzero(np.ones(values.shape, dtype=bool))
    order = np.lexsort((cols, -values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], cols[place < k]


def _merged(query: np.ndarray, group: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best different groups of every query."""
    order = np.lexsort((-value, group, query))
    query, group, value = query[order], group[order], value[order]
    first = (np.diff(query, prepend=query[0] - 1) != 0) | (np.diff(group, prepend=group[0] - 1) != 0)
    query, group, value = query[first], group[first], value[first]
    order = np.lexsort((group, -value, query))
    query, group, value = query[order], group[order], value[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[keep], group[keep], value[keep]


def summary(queries: DataFrame, stored: DataFrame, id: str, vector: str) -> DataFrame:
    """(query_id, n, total, best): over the stored vectors with a defined cosine to each query. Queries without any have
    no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def let_go() -> Iterator[pa.RecordBatch]:
            for query_ids, n, total, best in held.values():
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (query_ids, n, total, best)], names=["query_id", "n", "total", "best"])
            held.clear()

        for block, query_ids, _, sims in _pairs(batches):
            known = ~np.isnan(sims)
            own = [query_ids, known.sum(axis=1), np.where(known, sims, 0.0).sum(axis=1), np.where(known, sims, -np.inf).max(axis=1)]
            if block in held:
                old = held[block]
                own = [query_ids, old[1] + own[1], old[2] + own[2], np.maximum(old[3], own[3])]
            elif len(held) >= HELD:
                yield from let_go()
            held[block] = own
        yield from let_go()

    parts = _met(queries, stored, id, vector).mapInArrow(run, "query_id long, n long, total double, best double")
    return parts.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))
