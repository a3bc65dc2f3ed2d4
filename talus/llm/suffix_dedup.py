"""Repeated passages by a merge sort of sparse suffixes.

A byte is removed if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id. Sorting
the suffixes at every byte would move the corpus many times over, so only suffixes at anchors are sorted: a window
of LENGTH bytes has, among its GRAM-byte strings, one with the smallest hash, and equal windows have it at the same
place. About every 14th byte is an anchor.

1. Documents are dealt into runs by a hash. Each run sends the hashes of its anchors; a hash that one document alone
   has cannot belong to a repeated window, and its anchors are left out from here on.
2. Each run sorts what stands around its anchors: the LENGTH bytes from the anchor on, then the bytes before it,
   read backwards. Equal ones become one entry with the smallest id. The sorted entries are front-coded (the length
   of the prefix shared with the entry before, and the rest) and sent to the part that their hash names.
3. A part combines its runs with a loser tree. Every contestant carries the length of the prefix it shares with the
   last winner and the byte after it; where these differ they decide, and where they are equal bytes are compared from
   there on, so a known prefix is never compared again. The shared prefixes of neighbours come out with the order.
4. Neighbours with long shared prefixes are windows that repeat: for every offset of a window to its anchor, entries
   that agree on the window's bytes on both sides are a class, and an entry learns for which offsets its class has a
   smaller id than its own. The answer to a run is one number for each of its entries.
5. Each run makes its entries anew, marks the windows and removes what they cover.

An anchor hash that more than HOT documents have is not sorted by what stands around it, as the entries at the rim
of a passage differ from copy to copy and would meet in one part. Its windows are sorted one by one instead, dealt by
a hash of the whole window: equal windows of a run are one entry, different ones spread over all parts.

Every run sends to every part, so runs and parts grow with the root of the table: what they send one another stays
FRAGMENT_BYTES of text and its number grows with the table, until runs reach MOST_BYTES. The steps inside a run and a
part are done for all its parts and runs at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from talus.llm.common import forget, fresh, texts

LENGTH = 50  # bytes of a repeated string
GRAM = 24  # bytes of an anchor, a multiple of 8; shorter ones are met by chance in large tables, and all of their documents are sorted
SPAN = LENGTH - GRAM + 1  # grams in a window, and offsets of a window to its anchor
LEFT = SPAN - 1  # bytes before an anchor that a window can reach
KEY = LENGTH + LEFT + 2  # an entry: bytes from the anchor on, bytes before it, how many of each are real
SAME = KEY << 8 | 255  # the code of a key that equals the one before
RUN_BYTES = 4 << 20  # of text, for one run, and for one part of the sorted entries, at least
MOST_BYTES = 8 << 20  # of text, for one run or part of a large table: what a task holds
FRAGMENT_BYTES = 16 << 10  # of text, for what one run sends to one part, while runs have less than MOST_BYTES
BLOCK = 64 << 10  # bytes hashed at a time
DECODED = 4096  # keys decoded at a time
HOT = 4096  # documents, for parts of RUN_BYTES
NO_ID = -(1 << 63)  # a null id is smaller than any other
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)  # odd multipliers


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the gram at every byte, by which anchors are chosen."""
    with np.errstate(over="ignore"):
        each = (np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX[0]) >> np.uint64(24)).astype(np.uint32)
        h = each[data]
        width = 1
        while width < GRAM:
            step = min(width, GRAM - width)
            ahead = h[step:] >> np.uint32(15)
            ahead ^= h[step:]
            h = h[:-step] * np.uint32(MIX[1 + width.bit_length() % 4] >> 32 | 1)
            h += ahead
            width += step
        h ^= h >> np.uint32(16)
        h *= np.uint32(MIX[4] >> 32 | 1)
        h ^= h >> np.uint32(15)
    return np.maximum(h, 1)  # 0 is no window


def _gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit hashes, in the upper bits, of the grams at some places."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]).view(np.uint64)
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * np.uint64(MIX[j % 4])
            h ^= h >> np.uint64(29)
        h *= np.uint64(MIX[4])
        h ^= h >> np.uint64(32)
    return h & ~np.uint64(0xFFFF)


def bytes_of_run(total: int) -> int:
    """Bytes of text for a run, and for a part, of a table with so many bytes of text."""
    return min(max(RUN_BYTES, math.isqrt(total * FRAGMENT_BYTES)), MOST_BYTES)


def pack(docs: list[tuple[int | None, int, bytes]]) -> bytes:
    """Documents (id, tag, text) of one run as one compressed fragment."""
    head = np.zeros((len(docs), 4), dtype=np.int64)
    for i, (doc_id, tag, text) in enumerate(docs):
        head[i] = doc_id is not None, NO_ID if doc_id is None else doc_id, tag, len(text)
    size = np.int64(len(docs)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(size + head.tobytes() + b"".join([t for *_, t in docs]))


def unpack(blob: bytes) -> list[tuple[int, int, int, bytes]]:
    """(whether the id is known, id, tag, text) of each document of a fragment."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 4 * count, 8).reshape(count, 4)
    stops = 8 + head.nbytes + np.cumsum(head[:, 3])
    return [(*row[:3], data[stop - row[3] : stop]) for row, stop in zip(head.tolist(), stops.tolist())]


def pack_hashes(packed: np.ndarray) -> bytes:
    """Sorted hashes with counts in their low bytes, as differences of their upper 48 bits, byte by byte."""
    steps = np.diff(packed >> np.uint64(16), prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    counts = (packed & np.uint64(0xFF)).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes() + counts.tobytes())


def unpack_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(7, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, 2:] = planes[:6].T
    return np.cumsum(steps.view(">u8").ravel().astype(np.uint64), dtype=np.uint64), planes[6]


class Run:
    """The documents of a run: bytes, anchors, entries."""

    def __init__(self, fragments: pa.Table):
        docs = sorted((d for blob in fragments.column("docs").to_pylist() for d in unpack(blob)), key=lambda d: d[:3])
        self.null = [known == 0 for known, *_ in docs]
        self.ids = np.array([i for _, i, _, _ in docs], dtype=np.int64)
        self.tags = [tag for _, _, tag, _ in docs]
        held = [t for *_, t in docs]
        self.data = np.frombuffer(b"".join(held) or b"\0", dtype=np.uint8)
        sizes = np.array([len(t) for t in held], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self._find()

    def _find(self) -> None:
        """Anchors and their hashes, and the stretches of whole windows that have one smallest order: start of the first
        window, start of the last, order."""
        held = []
        first = 0
        while first < len(self.ids):
            last = int(np.searchsorted(self.starts, self.starts[first] + BLOCK))
            last = max(first + 1, min(last, len(self.ids)))
            begin, end = int(self.starts[first]), int(self.ends[last - 1])
            if end - begin >= LENGTH:
                h = _gram_order(self.data[begin:end])
                small = _sliding(h, SPAN, np.minimum)
                for stop in (self.ends[first:last] - begin).tolist():  # windows that reach into the next document
                    small[max(stop - LENGTH + 1, 0) : stop] = 0
                pad = np.zeros(SPAN - 1, dtype=np.uint32)
                chosen = np.flatnonzero((_sliding(np.concatenate([pad, small, pad]), SPAN, np.maximum) == h) & (h > 0))
                edges = np.flatnonzero(small[1:] != small[:-1]) + 1
                heads, tails = np.concatenate([[0], edges]), np.concatenate([edges, [len(small)]]) - 1
                own = small[heads] > 0
                held.append((chosen + begin, h[chosen], heads[own] + begin, tails[own] + begin, small[heads[own]]))
            first = last
        kinds = np.int64, np.uint32, np.int64, np.int64, np.uint32
        self.at, self.order, self.head, self.tail, self.least = [
            np.concatenate([block[i] for block in held]) if held else np.zeros(0, dtype=kind) for i, kind in enumerate(kinds)
        ]
        self.hash = _gram_hashes(self.data, self.at)
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def grams(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different anchor hashes in order, in how many documents each is (255 at most), the number of each anchor's
        hash, the hashes' numbers part by part, and where each part begins there."""
        order = np.argsort(self.hash)
        hashes = self.hash[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        number, kinds = np.cumsum(new) - 1, hashes[new]
        where = np.empty(len(order), dtype=np.int64)
        where[order] = number
        several = np.bincount(number, minlength=len(kinds)) > 1
        often = several[number]
        pairs = np.unique(number[often] * len(self.ids) + self.doc[order[often]]) // max(len(self.ids), 1)
        counts = np.where(several, np.bincount(pairs, minlength=len(kinds)), 1)
        of = _part(kinds, parts)
        by_part = np.argsort(of.astype(np.uint16) if parts <= 1 << 16 else of, kind="stable")
        return kinds, np.minimum(counts, 255), where, by_part, np.searchsorted(of[by_part], np.arange(parts + 1))

    def entries(self, parts: int, states: dict[int, tuple[bytes, bytes]]):
        """Sorted entries, part after part: the parts that have some, where each begins (and where the last ends),
        matrix of keys, smallest id of each, entry of each member, place of each member in the data, its id, whether
        the window starts there."""
        kinds, _, where, by_part, begins = self.grams(parts)
        shared, hot, of = np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds), dtype=np.int64)
        for part, (some, many) in states.items():
            mine = by_part[begins[part] : begins[part + 1]]
            shared[mine] = np.unpackbits(np.frombuffer(some, np.uint8), count=len(mine))
            hot[mine] = np.unpackbits(np.frombuffer(many, np.uint8), count=len(mine))
            of[mine] = part
        usual = np.flatnonzero((shared & ~hot)[where])
        place, docs, target = self.at[usual], self.doc[usual], of[where[usual]]
        left = np.minimum(place - self.starts[docs], LEFT)
        alone = np.zeros(len(usual), dtype=bool)
        if hot.any():
            crowds = np.unique(self.order[hot[where]])  # if others have such an order too, their windows are sorted in both ways
            crowded = np.flatnonzero(crowds[np.minimum(np.searchsorted(crowds, self.least), len(crowds) - 1)] == self.least)
            sizes = self.tail[crowded] - self.head[crowded] + 1
            single = np.arange(sizes.sum()) + np.repeat(self.head[crowded] - np.cumsum(sizes) + sizes, sizes)
            place, left = np.concatenate([place, single]), np.concatenate([left, np.zeros(len(single), dtype=np.int64)])
            docs = np.concatenate([docs, np.searchsorted(self.ends, single, side="right")])
            alone = np.arange(len(place)) >= len(usual)
        rows = self._rows(place, docs, left)
        if alone.any():
            target = np.concatenate([target, _part(_window_hash(rows[len(usual) :, 4:]), parts)])
        rows[:, :4] = target.astype(">u4").view(np.uint8).reshape(-1, 4)
        start = rows[:, :8].copy().view(">u8").ravel().astype(np.uint64)
        order = np.argsort(start)
        tie = start[order][1:] == start[order][:-1]
        tied = np.flatnonzero(np.append(tie, False) | np.append(False, tie))
        among = order[tied]
        order[tied] = among[np.argsort(rows[among].view(f"V{4 + KEY}").ravel())]
        rows = rows[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        ids, heads = self.ids[docs[order]], np.flatnonzero(new)
        least = np.minimum.reduceat(ids, heads) if len(heads) else ids
        held, starts = np.unique(target[order[heads]], return_index=True)
        bounds = np.append(starts, len(heads))
        return held, bounds, np.ascontiguousarray(rows[heads, 4:]), least, np.cumsum(new) - 1, place[order], ids, alone[order]

    def _rows(self, place: np.ndarray, docs: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Keys behind four bytes for the part."""
        rows = np.zeros((len(place), 4 + KEY), dtype=np.uint8)
        right = np.minimum(self.ends[docs] - place, LENGTH)
        padded = np.concatenate([np.zeros(LEFT, dtype=np.uint8), self.data, np.zeros(LENGTH, dtype=np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[place]
        rows[:, 4 : 4 + LENGTH] = around[:, LEFT:]
        rows[:, 4 + LENGTH : -2] = around[:, :LEFT][:, ::-1]
        for column, have, most in ((4, right, LENGTH), (4 + LENGTH, left, LEFT)):  # beyond the document's ends
            short = np.flatnonzero(have < most)
            span = slice(column, column + most)
            rows[short, span] = np.where(np.arange(most) < have[short, None], rows[short, span], 0)
        rows[:, -2], rows[:, -1] = right, left
        return rows

    def covered(self, marks: np.ndarray) -> np.ndarray:
        """Which bytes lie under a window that starts at a mark."""
        return _sliding(np.concatenate([np.zeros(LENGTH - 1, dtype=bool), marks]), LENGTH, np.logical_or)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts in even shares."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(23))) * np.uint64(MIX[2])
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(MIX[3])
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _window_hash(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(LENGTH):
            h = (h ^ keys[:, j]) * np.uint64(MIX[0])
            h ^= h >> np.uint64(29)
    return h


def _large(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def front_code(keys: np.ndarray, starts: np.ndarray | int = 0) -> tuple[bytes, bytes]:
    """(shared prefix lengths with the row before, the remaining bytes) of sorted rows; rows at `starts` stand whole."""
    shared = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        other = keys[1:] != keys[:-1]
        first = other.argmax(axis=1)
        shared[1:] = np.where(other[np.arange(len(first)), first], first, KEY)
        shared[starts] = 0
    rest = np.arange(KEY, dtype=np.uint8) >= shared[:, None]
    return shared.tobytes(), keys[rest].tobytes()


def front_decode(shared: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(shared, np.uint8)
    own = np.arange(KEY) >= lengths[:, None]
    keys = np.zeros((len(lengths), KEY), dtype=np.uint8)
    keys[own] = np.frombuffer(rest, np.uint8)
    for stop in range(DECODED, len(lengths) + DECODED, DECODED):
        some = slice(max(0, stop - DECODED - 1), stop)  # and the row before, which is whole by now
        whole = own[some].copy()
        whole[0] = True
        source = np.maximum.accumulate(np.where(whole, np.arange(len(whole))[:, None], 0), axis=0)
        keys[some] = np.take_along_axis(keys[some], source, axis=0)
    return lengths, keys


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of equal-length keys, each given with the shared prefix length to the key before in its run.

    Returns, in sorted order, the run, the number in the run, and the prefix shared with the key before. A node of
    the loser tree holds the run that lost there and the code of its head against the winner: the length of the
    shared prefix, and 255 less the byte after it. The larger code is the smaller key, and the loser's code holds
    against the new winner too; keys of equal codes agree on one byte more and are compared from there on. A run that
    is used up has the code -1 and loses against all others.
    """
    count = 1
    while count < len(runs):
        count *= 2
    keys = [r[0] for r in runs] + [[]] * (count - len(runs))
    codes = [[n << 8 | 255 - k[n] if n < KEY else SAME for k, n in zip(*r)] for r in runs] + [[]] * (count - len(runs))
    head = [k[0] if k else b"" for k in keys]
    sizes = [len(k) for k in keys]
    place = [0] * count
    loser, against = [0] * count, [0] * count

    def build(node: int) -> tuple[int, int]:
        if node >= count:
            return node - count, 255 - head[node - count][0] if keys[node - count] else -1
        (a, x), (b, y) = build(2 * node), build(2 * node + 1)
        if y > x:
            a, x, b, y = b, y, a, x
        elif x == y >= 0 and head[a] == head[b]:
            y = SAME
        elif x == y >= 0:
            if head[b] < head[a]:
                a, b = b, a
            shared = _shared(head[a], head[b], 1)
            y = shared << 8 | 255 - head[b][shared]
        loser[node], against[node] = b, y
        return a, x

    winner, code = build(1) if count > 1 else (0, 0 if keys[0] else -1)
    out_run, out_place, out_shared = [], [], []
    while code >= 0:
        out_run.append(winner)
        out_place.append(at := place[winner])
        out_shared.append(code >> 8)
        place[winner] = at = at + 1
        if at < sizes[winner]:
            head[winner], code = keys[winner][at], codes[winner][at]
        else:
            code = -1
        node = (winner + count) >> 1
        while node:
            other = against[node]
            if other > code:
                against[node], code = code, other
                loser[node], winner = winner, loser[node]
            elif other == code != -1:
                b = loser[node]
                x, y = head[winner], head[b]
                if x == y:
                    against[node] = SAME
                else:
                    if y < x:
                        loser[node], winner, y = winner, b, x
                        x = head[b]
                    shared = _shared(x, y, (code >> 8) + 1)
                    against[node] = shared << 8 | 255 - y[shared]
            node >>= 1
    return out_run, out_place, out_shared


def _shared(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two keys of one length that agree on `known` bytes."""
    return KEY - ((int.from_bytes(x[known:]) ^ int.from_bytes(y[known:])).bit_length() + 7 >> 3)


def repeated_offsets(keys: np.ndarray, shared: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each merged entry the offsets (bits) at which its window also stands in an entry with a smaller id.

    `keys` are the merged entries in order, `shared` their prefixes shared with the entry before, `least` their ids.
    """
    new = shared < KEY
    different = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    kept, first = keys[heads], np.minimum.reduceat(least, heads)
    before = shared[heads].copy()
    before[:1] = 0
    right, left = kept[:, -2].astype(int), kept[:, -1].astype(int)
    masks = np.zeros(len(keys), dtype=np.uint64)
    # entries whose first GRAM bytes no other entry has: all their copies are whole entries
    group = np.cumsum(before < GRAM) - 1
    lonely = np.bincount(group)[group] == 1
    usable = np.zeros(len(heads), dtype=np.uint64)
    for o in range(SPAN):
        usable |= ((left >= o) & (right >= LENGTH - o)).astype(np.uint64) << np.uint64(o)
    masks = np.where(lonely[different] & (first[different] < least), usable[different], np.uint64(0))
    mixed = np.flatnonzero(~lonely)
    if not len(mixed):
        return masks
    rows = np.flatnonzero(~lonely[different])
    back = np.searchsorted(mixed, different[rows])
    first, right, left, group = first[mixed], right[mixed], left[mixed], group[mixed]
    # the other side: order by the bytes before the anchor inside a group, and how many of them neighbours share
    sides = np.zeros((len(mixed), 4 + LEFT), dtype=np.uint8)
    sides[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    sides[:, 4:] = kept[mixed, LENGTH : LENGTH + LEFT]
    by_side = np.argsort(sides.view(f"V{4 + LEFT}").ravel())
    sides = sides[by_side]
    other = np.ones((len(mixed), 5 + LEFT), dtype=bool)
    other[1:, :-1] = sides[1:] != sides[:-1]
    close = other.argmax(axis=1) - 4  # below 0: another group
    close[0] = -1
    side = np.empty(len(mixed), dtype=np.int64)
    for o in range(SPAN):
        fits = (left >= o) & (right >= LENGTH - o)
        if not fits.any():
            continue
        # classes of one entry have no smaller id than the entry's own
        ahead = np.cumsum(before < LENGTH - o)[mixed]
        side[by_side] = np.cumsum(close < o)
        pair = np.flatnonzero(fits & (np.bincount(ahead)[ahead] > 1) & (np.bincount(side)[side] > 1))
        smallest = np.where(fits, first, np.iinfo(np.int64).max)
        if len(pair):
            kind = ahead[pair] * (len(mixed) + 1) + side[pair]
            order = np.argsort(kind)
            kind, pair = kind[order], pair[order]
            new = np.ones(len(kind), dtype=bool)
            new[1:] = kind[1:] != kind[:-1]
            smallest[pair] = np.minimum.reduceat(first[pair], np.flatnonzero(new))[np.cumsum(new) - 1]
        masks[rows] |= (smallest[back] < least[rows]).astype(np.uint64) << np.uint64(o)
    return masks


def _by_part(replies: pa.Table) -> dict[int, dict]:
    return {row["part"]: row for row in replies.to_pylist()}


def repeats(docs: DataFrame, runs: int | None = None, parts: int | None = None, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; `with_text` adds `tag` (a hash of
    the text that tells rows of one id apart), `text` (what stays; a character of which a byte goes, goes as a whole)
    and `spans` (start and stop of every removed stretch of bytes, as consecutive numbers).

    A null text is empty. A null id is smaller than any other. Rows with the same id never remove each other's bytes.
    """
    source = texts(docs)
    if runs is None or parts is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        size = bytes_of_run(total)
        runs, parts, hot = runs or max(1, -(-total // size)), parts or max(1, -(-total // size)), hot * size // RUN_BYTES
    dealt = source.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)).cast("int").alias("run"), "doc_id", F.xxhash64("text").alias("tag"), "text")

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            held: dict[int, list] = {}
            for run, doc_id, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary())):
                held.setdefault(run, []).append((doc_id, tag, text.as_py()))
            blobs = [pack(docs) for docs in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["run", "docs"])

    def send_hashes(table: pa.Table) -> pa.Table:
        run = Run(table)
        kinds, counts, _, by_part, stops = run.grams(parts)
        packed = (kinds | counts.astype(np.uint64))[by_part]
        held = np.flatnonzero(stops[:-1] < stops[1:]).tolist()
        number = table.column("run")[0].as_py()
        return pa.table({
            "part": pa.array(held, pa.int32()), "run": pa.array([number] * len(held), pa.int32()),
            "hashes": pa.array([pack_hashes(packed[stops[p] : stops[p + 1]]) for p in held], pa.binary()),
        })

    def judge_hashes(table: pa.Table) -> pa.Table:
        blobs, counts = zip(*[unpack_hashes(b) for b in table.column("hashes").to_pylist()])
        _, inverse = np.unique(np.concatenate(blobs), return_inverse=True)
        documents = np.bincount(inverse, weights=np.concatenate(counts).astype(float))[inverse]
        stops = np.cumsum([0, *map(len, blobs)])
        cut = [documents[a:b] for a, b in zip(stops, stops[1:])]
        keep = [i for i, d in enumerate(cut) if (d > 1).any()]
        return pa.table({
            "run": table.column("run").take(pa.array(keep, pa.int64())), "part": table.column("part").take(pa.array(keep, pa.int64())),
            "shared": pa.array([np.packbits(cut[i] > 1).tobytes() for i in keep], pa.binary()),
            "many": pa.array([np.packbits(cut[i] > hot).tobytes() for i in keep], pa.binary()),
        })

    def states_of(replies: dict[int, dict]) -> dict[int, tuple[bytes, bytes]]:
        return {p: (row["shared"], row["many"]) for p, row in replies.items() if row["shared"] is not None}

    def send_runs(table: pa.Table, judged: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and judged.num_rows:
            number, replies, small = table.column("run")[0].as_py(), _by_part(judged), zstandard.ZstdCompressor(level=3).compress
            held, bounds, keys, least, *_ = Run(table).entries(parts, states_of(replies))
            prefix, rest = front_code(keys, bounds[:-1])
            cuts = np.concatenate([[0], np.cumsum(KEY - np.frombuffer(prefix, np.uint8).astype(np.int64))])[bounds].tolist()
            for i, (part, a, b) in enumerate(zip(held.tolist(), bounds.tolist(), bounds[1:].tolist())):
                own = replies.get(part, {})
                coded = prefix[a:b], rest[cuts[i] : cuts[i + 1]], least[a:b].tobytes()
                rows.append((part, number, *map(small, coded), own.get("shared"), own.get("many")))
            # states travel with the entries, also to parts that get none
            sent = set(held.tolist())
            rows += [(p, number, b"", b"", b"", row["shared"], row["many"]) for p, row in replies.items() if p not in sent]
        return _arrow(rows, RUNS)

    def merge_part(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["run"])
        held = [i for i, row in enumerate(rows) if row["prefix"]]
        answers = [b""] * len(rows)
        if held:
            large, small = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
            prefixes = [large(rows[i]["prefix"]) for i in held]
            # the first entry of each run stands whole, so all are decoded together
            lengths, keys = front_decode(b"".join(prefixes), b"".join([large(rows[i]["rest"]) for i in held]))
            least = np.frombuffer(b"".join([large(rows[i]["least"]) for i in held]), np.int64)
            bases = np.cumsum([0, *map(len, prefixes)])
            flat, known = keys.tobytes(), lengths.tolist()
            flat = [flat[a : a + KEY] for a in range(0, len(flat), KEY)]
            order = [np.array(x, dtype=np.int64) for x in merge_runs([(flat[a:b], known[a:b]) for a, b in zip(bases, bases[1:])])]
            where = bases[order[0]] + order[1]
            found = np.zeros(len(where), dtype=np.uint64)
            found[where] = repeated_offsets(keys[where], order[2], least[where])
            for n, i in enumerate(held):
                answers[i] = small(found[bases[n] : bases[n + 1]].tobytes())
        return _arrow([(row["run"], row["part"], a, row["shared"], row["many"]) for row, a in zip(rows, answers)], ANSWERS)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _arrow([], result)
        run, replies = Run(table), _by_part(answers)
        marks = np.zeros(len(run.data), dtype=bool)
        held, bounds, _, least, entry, place, ids, alone = run.entries(parts, states_of(replies))
        if len(held):
            bits = np.frombuffer(b"".join([_large(replies[part]["offsets"]) for part in held.tolist()]), np.uint64)[entry]
            # a copy in the same run with a smaller id shows in the entry itself: all its windows repeat
            docs = np.searchsorted(run.ends, place, side="right")
            room_left, room_right = np.minimum(place - run.starts[docs], LEFT), np.minimum(run.ends[docs] - place, LENGTH)
            later = ids > least[entry]
            for o in range(SPAN):
                fits = (room_left >= o) & (room_right >= LENGTH - o) & (~alone if o else True)
                hit = fits & (later | (bits >> np.uint64(o) & np.uint64(1)).astype(bool))
                marks[place[hit] - o] = True
        gone, rows = run.covered(marks), []
        for i, (a, b) in enumerate(zip(run.starts.tolist(), run.ends.tolist())):
            lost = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8)))
            kept = run.data[a:b][~lost].tobytes() if len(edges) else run.data[a:b].tobytes()
            row = (None if run.null[i] else int(run.ids[i]), b - a, int(lost.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
            rows.append((*row, run.tags[i], kept.decode("utf-8", "ignore"), edges.tolist()) if with_text else row)
        return _arrow(rows, result)

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        result += [("tag", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))]
        schema += ", tag long, text string, spans array<long>"
    by_run = dealt.mapInArrow(fragments, "run int, docs binary").groupBy("run")
    hashes = by_run.applyInArrow(send_hashes, "part int, run int, hashes binary")
    judged = hashes.groupBy("part").applyInArrow(judge_hashes, "run int, part int, shared binary, many binary")
    sorted_runs = by_run.cogroup(judged.groupBy("run")).applyInArrow(
        send_runs, "part int, run int, prefix binary, rest binary, least binary, shared binary, many binary"
    )
    answers = sorted_runs.groupBy("part").applyInArrow(merge_part, "run int, part int, offsets binary, shared binary, many binary")
    return by_run.cogroup(answers.groupBy("run")).applyInArrow(remove, schema)


RUNS = [("part", pa.int32()), ("run", pa.int32()), ("prefix", pa.binary()), ("rest", pa.binary()), ("least", pa.binary()), ("shared", pa.binary()), ("many", pa.binary())]
ANSWERS = [("run", pa.int32()), ("part", pa.int32()), ("offsets", pa.binary()), ("shared", pa.binary()), ("many", pa.binary())]


def _arrow(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], schema=pa.schema(fields))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, their texts without repeated passages, one for each input row. A column
    `n_chars` counts the new text. A text that repeats as a whole stays as an empty one. Rows that repeat an id and a text
    get the same new text, whatever their other columns hold."""
    # an id and a text name what stays; null ids are told apart from the id 0
    *keys, new_text = fresh(docs, "new_id", "new_null", "new_tag", "new_text")
    doc_id = F.col("doc_id").cast("long")
    named = [F.coalesce(doc_id, F.lit(0)).alias(keys[0]), doc_id.isNull().alias(keys[1])]
    new = repeats(docs, with_text=True).select(*named, F.col("tag").alias(keys[2]), F.col("text").alias(new_text))
    tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(keys[2])
    own = docs.select(*[c for c in docs.columns if c != "text"], *named, tag)
    joined = own.join(new.groupBy(*keys).agg(F.first(new_text).alias(new_text)), keys)
    of = {"text": F.col(new_text), "n_chars": F.length(new_text).cast("long")}
    return joined.select(*[of[c].alias(c) if c in of else F.col(c) for c in docs.columns])
