"""Best-fit packing with a swap-based local search.

Pieces are dealt by a hash into groups of bounded size, and each group is packed on its own: best-fit decreasing
first, then the local search. Every step of the search takes tokens from bins that are less full and gives them to
the fullest bin that still has room, so the sum of squared fills rises until no exchange helps; bins that lose their
last piece disappear. A group of some ten thousand pieces leaves about one bin partly filled, so dealing costs next
to nothing against packing everything at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from talus.llm import tokens
from talus.llm.common import map_rows, stored, texts

SIZE = 1024
GROUP = 20_000  # pieces packed together, on average


def best_fit(sizes: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing. Returns bins as lists of positions in `sizes`."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free tokens
    free_mask = 0  # bit r: there is a bin with r free tokens
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need = sizes[item]
        fitting = free_mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            chosen = room[free].pop()
            if not room[free]:
                free_mask &= ~(1 << free)
        else:
            chosen, free = len(bins), size
            bins.append([])
        bins[chosen].append(item)
        room[free - need].append(chosen)
        free_mask |= 1 << (free - need)
    return bins


class _Stock:
    """Pieces of the bins that may still give: sizes present as bits, and which pieces have a size."""

    def __init__(self, sizes: list[int], bins: dict[int, list[int]]):
        self.of: dict[int, set[tuple[int, int]]] = {}
        self.mask = 0
        for b, items in bins.items():
            for item in items:
                self.add(sizes[item], b, item)

    def add(self, size: int, b: int, item: int) -> None:
        self.of.setdefault(size, set()).add((b, item))
        self.mask |= 1 << size

    def remove(self, size: int, b: int, item: int) -> None:
        held = self.of[size]
        held.discard((b, item))
        if not held:
            self.mask &= ~(1 << size)

    def largest(self, limit: int) -> int:
        """The largest size up to `limit`, 0 if none."""
        return (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.mask & ((1 << (limit + 1)) - 2) else 0

    def any(self, size: int) -> tuple[int, int]:
        return min(self.of[size])


def improve(sizes: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Local search until no exchange helps. Fuller bins choose first; each takes from the less full ones."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill) if f >= size]
    open_bins = {k: list(b) for k, (b, f) in enumerate(zip(bins, fill)) if f < size}
    changed = True
    while changed:
        changed = False
        stock = _Stock(sizes, open_bins)
        pairs = {k: _pair_sums(sizes, items) for k, items in open_bins.items()}  # of the bins that still give
        for b in sorted(open_bins, key=lambda k: -fill[k]):
            items = open_bins[b]
            del pairs[b]
            if not items:
                continue
            for item in items:
                stock.remove(sizes[item], b, item)
            while fill[b] < size and (step := _step(sizes, items, size - fill[b], stock) or _two_for_one(sizes, items, size - fill[b], open_bins, pairs)):
                leave, enter = step
                for donor, item in enter:
                    stock.remove(sizes[item], donor, item)
                    open_bins[donor].remove(item)
                    fill[donor] -= sizes[item]
                    items.append(item)
                    fill[b] += sizes[item]
                giver = enter[0][0]
                for item in leave:
                    items.remove(item)
                    fill[b] -= sizes[item]
                    open_bins[giver].append(item)
                    fill[giver] += sizes[item]
                    stock.add(sizes[item], giver, item)
                pairs[giver] = _pair_sums(sizes, open_bins[giver])
                changed = True
        done += [b for k, b in open_bins.items() if b and fill[k] >= size]
        open_bins = {k: b for k, b in open_bins.items() if b and fill[k] < size}
    return done + list(open_bins.values())


def _pair_sums(sizes: list[int], items: list[int]) -> int:
    """The sums of two pieces of a bin, as bits."""
    sums = seen = 0
    for item in items:
        sums |= seen << sizes[item]
        seen |= 1 << sizes[item]
    return sums


def _two_for_one(sizes: list[int], items: list[int], gap: int, bins: dict[int, list[int]], pairs: dict[int, int]):
    """(the piece that leaves, two of one bin that enter for it) with the largest gain up to `gap`, or None."""
    every = 0
    for sums in pairs.values():
        every |= sums
    best, leaves, total = 0, -1, 0
    for y in items:
        top = (every & ((1 << (gap + sizes[y] + 1)) - 1)).bit_length() - 1
        if top - sizes[y] > best:
            best, leaves, total = top - sizes[y], y, top
    if not best:
        return None
    giver = min(k for k, sums in pairs.items() if sums >> total & 1)
    seen: dict[int, int] = {}
    for item in bins[giver]:
        if total - sizes[item] in seen:
            return [leaves], [(giver, seen[total - sizes[item]]), (giver, item)]
        seen.setdefault(sizes[item], item)


def _step(sizes: list[int], items: list[int], gap: int, stock: _Stock):
    """(pieces that leave, pieces that enter) with the largest gain up to `gap`, or None: a move, one for one, or one for
    two that leave. A giver never gets more than it gives."""
    best, found = 0, None
    if (x := stock.largest(gap)) > best:
        best, found = x, ([], [stock.any(x)])
    for i, y in enumerate(items):
        if best == gap:
            break
        x = stock.largest(gap + sizes[y])
        if x - sizes[y] > best:
            best, found = x - sizes[y], ([y], [stock.any(x)])
        for z in items[i + 1 :]:
            x = stock.largest(gap + sizes[y] + sizes[z])
            if x - sizes[y] - sizes[z] > best:
                best, found = x - sizes[y] - sizes[z], ([y, z], [stock.any(x)])
    return found


def pack_group(sizes: list[int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for number, items in enumerate(improve(sizes, best_fit(sizes, size), size)):
        at = 0
        for item in sorted(items):
            where[item], offset[item] = number, at
            at += sizes[item]
    return where, offset


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = tokens.END_ID, digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every whole text and the end id, cut into `size` ids where they
    are more; the first piece takes what is left over. `digest`: ids_crc32 instead of ids. A null text is empty; it
    has one piece, the end id."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, ids in tokens.encoder(vocabulary).encode_all(rows):
            ids = tokens.with_end(ids, end_id)
            at, n, piece = 0, len(ids) // 4, 0
            while at < n:
                length = ((n - 1) % size) + 1 if piece == 0 else size
                own = ids[4 * at : 4 * (at + length)]
                yield doc_id, piece, at, length, zlib.crc32(own) if digest else own
                at, piece = at + length, piece + 1

    return map_rows(texts(docs), f"doc_id long,piece int,start long,length long,{'ids_crc32 long' if digest else 'ids binary'}", run)


def pack(narrow: DataFrame, key: list[str], length: str = "length", size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows of (key, length, ...). Whole lengths up to `size`; rows are dealt by a hash
    of the key and a row number, so that repeated keys spread. Give it narrow, stored rows: they are read twice."""
    count = narrow.count()
    groups = max(1, -(-count // group))
    dealt = narrow.withColumn("_group", F.pmod(F.xxhash64(*key, F.spark_partition_id()), F.lit(groups)).cast("long"))
    schema = StructType([*dealt.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, length], kind="stable").reset_index(drop=True)
        where, offset = pack_group(pdf[length].tolist(), size)
        return pdf.assign(sequence_id=pdf["_group"] * (1 << 32) + where, offset=offset)

    return dealt.groupBy("_group").applyInPandas(run, schema).drop("_group")


def packed_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """All pieces with their places; `ids_crc32` stands for the ids."""

    return pack(stored(pieces(docs, vocabulary, size, digest=True), "pieces"), ["doc_id", "piece"], size=size)
