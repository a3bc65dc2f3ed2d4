"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is: length of the payload (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the
payload (4); all little-endian. The payload is: bytes per id (1), document id (8), whether the id is null (1), ids. A masked checksum is CRC-32
rotated right by 15 bits plus a constant, so that a checksum stored inside a payload is not mistaken for its own.

Documents are range-partitioned by id; partition p writes file p in id order, so files in name order hold all
documents in id order. Every attempt of a task writes a file of its own name, and the index names the file of the
attempt that Spark accepted: lost executors and retries leave unused files at worst. Files go through pyarrow's file
systems to a folder that all executors reach.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from talus.llm import tokens
from talus.llm.common import map_rows, parts_for, texts
from talus.session import scratch

MASK = 0xA282EAD8  # fixed value of the record format
HEAD, START = "<QI", "<BqB"
HEAD_SIZE, TAIL_SIZE, START_SIZE = 12, 4, 10


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def record(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = struct.pack(START, wide, 0 if doc_id is None else doc_id, doc_id is None) + ids.astype(f"<u{wide}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and ids of one whole record; ValueError if a length or checksum is wrong."""
    size, check = struct.unpack_from(HEAD, data)
    payload, tail = data[HEAD_SIZE : HEAD_SIZE + size], data[HEAD_SIZE + size :]
    if masked(data[:8]) != check or len(tail) != TAIL_SIZE or struct.unpack("<I", tail)[0] != masked(payload):
        raise ValueError("damaged record")
    wide, doc_id, unknown = struct.unpack_from(START, payload)
    return None if unknown else doc_id, np.frombuffer(payload, f"<u{wide}", offset=START_SIZE)


def _store(path: str):
    from pyarrow import fs

    if path.startswith("/"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = tokens.END_ID, parts: int | None = None) -> DataFrame:
    """Encode every whole text, write the records below `folder`, and return the index: doc_id, file, part, place
    (number in the file), offset, size (bytes of the record). Nothing is written before the index is computed; write
    the index once and read it back.

    A null text is empty and gives a record of the end id alone; repeated ids give a record each, in any order among
    themselves; a null id comes first; an empty table has an empty index.
    """
    source = texts(docs)
    if parts is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0]
        parts = parts_for(total, docs.sparkSession)
    ordered = source.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        out, offset, part = None, 0, TaskContext.get().partitionId()
        try:
            for place, (doc_id, ids) in enumerate(tokens.encoder(vocabulary).encode_all(rows)):
                if out is None:
                    store, base = _store(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{part:06d}-{uuid.uuid4().hex}.records"
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                data = record(doc_id, np.frombuffer(tokens.with_end(ids, end_id), "<u4"))
                out.write(data)
                yield doc_id, name, part, place, offset, len(data)
                offset += len(data)
        finally:
            if out is not None:
                out.close()

    return map_rows(ordered, "doc_id long,file string,part int,place long,offset long,size long", run)


def _records(rows: Iterator[tuple], folder: str) -> Iterator[tuple]:
    store = opened = held = None
    for name, part, place, offset, size in rows:
        if store is None:
            store, base = _store(folder)
        if name != opened:
            opened, held = name, store.open_input_file(f"{base}/{name}")
        held.seek(offset)
        doc_id, ids = parse(held.read(size))
        yield doc_id, part, place, ids.astype("<u4").tobytes()


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, part, place, ids) of the index's records, checked; `ids` are little-endian unsigned 32-bit bytes. Rows of
    the index may come in any order and number."""
    narrow = index.select("file", "part", "place", "offset", "size")
    return map_rows(narrow, "doc_id long,part int,place long,ids binary", lambda rows: _records(rows, folder), block=512)


def count_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, part, place, n_tokens, ids_crc32) of the index's records; the ids stay inside the task."""
    narrow = index.select("file", "part", "place", "offset", "size")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, part, place, ids in _records(rows, folder):
            yield doc_id, part, place, len(ids) // 4, zlib.crc32(ids)

    return map_rows(narrow, "doc_id long,part int,place long,n_tokens long,ids_crc32 long", run)


def token_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents, read the files back and tell for each document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder, table = scratch(spark, "token-files"), scratch(spark, "token-index")
    index = write_records(docs, vocabulary, folder)
    index.write.parquet(table)
    index = spark.read.schema(index.schema).parquet(table)

    back = count_records(index, folder)
    table = scratch(spark, "token-counts")
    back.write.parquet(table)
    back = spark.read.schema(back.schema).parquet(table)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = back.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    located = back.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return located.join(parts, F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
