"""Fill-in-middle transformation over a sparse exception index.

A UTF-8 text is bytes; only characters of more than one byte make code points and bytes drift apart. The index keeps
just those: the code-point position of every multibyte character and the excess bytes up to it. A cut at a code point
becomes a byte by adding the excess of the exceptions before it, found with `searchsorted`, and a byte becomes a code
point the other way round; between two exceptions, and in all of an ASCII text, this is plain arithmetic. One index
serves a whole slice of an Arrow batch, whose texts lie behind each other in one buffer.

The cuts come from a digest of the id alone, so a document is cut alike wherever and however often it is processed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talus.llm.common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20  # percent of the documents that are transformed, and of those in suffix-prefix-middle order
SLICE = 4 << 20  # bytes of text that one index covers; a longer text has an index of its own
BLOCK = 1 << 20  # bytes looked at together while an index is built


class Exceptions:
    """Multibyte characters of UTF-8 bytes: `points`, their code-point positions, and `excess`, the bytes beyond one
    per character that they and those before them take (with a leading 0)."""

    def __init__(self, data: np.ndarray):
        at, more = [], []
        for start in range(0, len(data), BLOCK):
            part = data[start : start + BLOCK]
            lead = np.flatnonzero(part >= 0xC0)
            first = part[lead]
            at.append(lead + start)
            more.append(1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0))
        self.excess = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *more]))])
        self.points = np.concatenate([np.zeros(0, np.int64), *at]) - self.excess[:-1]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte offsets of code-point positions."""
        return points + self.excess[np.searchsorted(self.points, points, side="left")]

    def to_points(self, offsets: np.ndarray) -> np.ndarray:
        """Code-point positions of byte offsets; an offset inside a character counts as its start."""
        before = np.searchsorted(self.points + self.excess[:-1], offsets, side="left")
        whole = offsets - self.excess[before]
        # inside the exception before it, an offset is not yet past all of its bytes
        inside = self.points[np.maximum(before - 1, 0)] if len(self.points) else whole
        return np.where((before > 0) & (whole <= inside), inside, whole)


def _draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of an id; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _edges(column: pa.LargeBinaryArray) -> np.ndarray:
    """Where each text begins in the column's buffer, and where the last one ends."""
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take at most SLICE bytes, or one row."""
    edges = _edges(batch.column("text").cast(pa.large_binary()))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(edges, edges[start] + SLICE, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _cut(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    column = batch.column("text").cast(pa.large_binary())
    edges, values = _edges(column), column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[edges[0] : edges[-1]] if values is not None else np.zeros(0, np.uint8)
    held, edges = memoryview(data), edges - edges[0]
    index = Exceptions(data)
    first = index.to_points(edges)
    n = np.diff(first)
    h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    to_prefix, to_middle = index.to_bytes(first[:-1] + low), index.to_bytes(first[:-1] + high)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    form, output = [], []
    for i in range(batch.num_rows):
        a, b, c, d = int(edges[i]), int(to_prefix[i]), int(to_middle[i]), int(edges[i + 1])
        text = bytes(held[a:d])
        if not text or any(m in text for m in marks) or h[2][i] % 100 >= rate:
            form.append("plain")
            output.append(text)
        elif h[3][i] % 100 < spm:
            form.append("spm")
            output.append(b"".join((marks[1], held[c:d], marks[0], held[a:b], marks[2], held[b:c])))
        else:
            form.append("psm")
            output.append(b"".join((marks[0], held[a:b], marks[1], held[c:d], marks[2], held[b:c])))
    plain = np.array([f == "plain" for f in form], dtype=bool)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(low, pa.int64(), mask=plain),
         pa.array(high - low, pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def transformed(docs: DataFrame, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of `docs` (doc_id, text).

    `rate` percent of the documents get a form with marked parts, `spm` percent of these with the suffix first; the
    other documents, and those that are empty or hold a mark themselves, stay plain, with no part lengths. A null text
    is empty; a null id draws from the empty string; rows that repeat an id are cut by the same draws, each in its own
    length. Other columns are not looked at. A text has to be valid UTF-8. Memory follows the slice, or one text: eight
    bytes twice for every multibyte character, and the text's output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _cut(part, rate, spm)

    rows = texts(docs).select("doc_id", "text", *_draws(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a mark, and no mark can begin inside another, so the marks
    found from left to right are the ones that were set."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transformed(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
