"""Byte-level BPE as a monoid: token sequences joined at their border, in a balanced tree.

A match is halved until its parts have a few bytes; the parts' tokens are then joined upwards. A join re-encodes a
window of the last tokens on the left and the first tokens on the right. It is done once the new tokens agree with the untouched
neighbours on both sides: a sequence of tokens is the encoding of its bytes exactly if every two neighbours are the
encoding of their own bytes, so nothing outside a window that agrees on both sides can change. Otherwise the window
grows on the side that disagrees.

Ranks are a vocabulary's merges in order; a token's rank is its id. Each match of the vocabulary's pattern is
encoded on its own. Decoding concatenates the tokens' bytes, halves first, so it is the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from talus.llm.common import map_rows, per_process, texts

MEMORY = 300_000  # matches and parts remembered per process; beyond it the memory starts anew
SHORT = 24  # matches and parts up to so many bytes are remembered
LEAF = 8  # bytes of a part that is encoded by the plain rule
NONE = 1 << 40  # cost of a pair that is no token


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeEncoder:
    """encode(bytes of one match) -> ids; decode(ids) -> bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = dict(zip(ranks.values(), ranks.keys()))
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.agreeing: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The ids of a short stretch by the plain rule: merge the neighbours of lowest rank, leftmost first."""
        get = self.ranks.get
        held = [text[i : i + 1] for i in range(len(text))]
        costs = [get(a + b, NONE) for a, b in zip(held, held[1:])]
        while costs and (lowest := min(costs)) < NONE:
            at = costs.index(lowest)
            held[at : at + 2] = [new := held[at] + held[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = get(new + held[at + 1], NONE)
            if at:
                costs[at - 1] = get(held[at - 1] + new, NONE)
        return [self.ranks[t] for t in held]

    def agree(self, left: int, right: int) -> bool:
        """Whether two neighbouring ids are the encoding of their own bytes."""
        pair = (left, right)
        known = self.agreeing.get(pair)
        if known is None:
            if len(self.agreeing) > 4 * MEMORY:
                self.agreeing.clear()
            known = self.agreeing[pair] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join([self.token[t] for t in left[-i:] + right[:j]]))
            before = i >= len(left) or self.agree(left[-i - 1], window[0])
            after = j >= len(right) or self.agree(window[-1], right[j])
            if before and after:
                return left[:-i] + tuple(window) + right[j:]
            if not before:
                i = min(2 * i, len(left))
            if not after:
                j = min(2 * j, len(right))

    def part(self, text: bytes) -> tuple[int, ...]:
        """Ids of a stretch: of its halves, joined."""
        known = self.parts.get(text)
        if known is not None:
            return known
        if len(text) <= LEAF:
            ids = tuple(self.merged(text))
        else:
            half = len(text) // 2
            ids = self.join(self.part(text[:half]), self.part(text[half:]))
        if len(text) <= SHORT:
            if len(self.parts) > MEMORY:
                self.parts.clear()
            self.parts[text] = ids
        return ids


class _Matches(dict):
    """Match -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tree: TreeEncoder):
        super().__init__()
        self.part = tree.part

    def __missing__(self, match: str) -> bytes:
        ids = array("I", self.part(match.encode())).tobytes()
        if len(match) <= SHORT:
            self[match] = ids
        return ids


class _Pieces(dict):
    """What stands between two single spaces (the space before it left off) -> ids of its matches."""

    def __init__(self, matches: _Matches, pattern: str):
        super().__init__()
        import regex

        self.matches, self.split = matches, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        spaced = " " + piece
        ids = self.matches[spaced] if piece.isalpha() else b"".join([self.matches[m] for m in self.split(spaced)])
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


class TextEncoder:
    """Whole texts. No match of the pattern crosses a single space between two characters that are not white space,
    so texts are cut there, and the ids of the pieces are remembered."""

    def __init__(self, path: str, pattern: str):
        self.tree = TreeEncoder(load_ranks(path))
        self.matches = _Matches(self.tree)
        self.pieces = _Pieces(self.matches, pattern)
        self.odd = re.compile(r" [\s\x1c-\x1f\x85]| $")
        lengths = np.array([len(self.tree.token.get(i, b"")) for i in range(max(self.tree.token) + 1)])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.tree.token.get(i, b"") for i in range(len(lengths))), dtype=np.uint8)

    def _matched(self, text: str) -> list[bytes]:
        return [self.matches[m] for m in self.pieces.split(text)]

    def encode(self, text: str) -> bytes:
        for memory in (self.pieces, self.matches):
            if len(memory) > MEMORY:
                memory.clear()
        if self.odd.search(text):
            return b"".join(self._matched(text))
        first, *rest = text.split(" ")
        return b"".join(self._matched(first)) + b"".join(map(self.pieces.__getitem__, rest))

    def decode(self, ids: bytes, block: int = 1 << 14) -> bytes:
        """The bytes of a sequence: of its halves, concatenated, down to blocks that are gathered at once."""
        held = np.frombuffer(ids, dtype="<u4")
        if len(held) > block:
            half = len(held) // 2
            return self.decode(ids[: 4 * half], block) + self.decode(ids[4 * half :], block)
        starts, lengths = self.ends[held], self.ends[held + 1] - self.ends[held]
        stops = np.cumsum(lengths)
        if not len(held):
            return b""
        where = np.arange(stops[-1]) + np.repeat(starts - (stops - lengths), lengths)
        return self.bytes[where].tobytes()


def encoder(path: str, pattern: str) -> TextEncoder:
    return per_process(f"tree:{path}", lambda: TextEncoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for every row; ids as little-endian unsigned 32-bit bytes. A null or empty text has no ids."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        made = encoder(path, pattern)
        for doc_id, text in rows:
            yield doc_id, made.encode(text)

    return map_rows(texts(docs), "doc_id long,ids binary", run)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) as bytes, from (doc_id, ids)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        made = encoder(path, pattern)
        for doc_id, ids in rows:
            yield doc_id, made.decode(ids or b"")

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long,text binary", run)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: encoded, and decoded from the ids, in one task."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        made = encoder(path, pattern)
        for doc_id, text in rows:
            ids = made.encode(text)
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(made.decode(ids)).hexdigest()

    return map_rows(texts(docs), "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string", run)
