"""Token ids of whole texts through the tokenizers library.

A text may be cut before every single space that stands between two non-space characters: byte-level pre-tokens
never cross such a place (the space belongs to the word after it). Pieces between cuts repeat a lot, so each process
asks the library only for words it has not seen lately and joins the remembered ids. Texts with other white space after
a space go to the library whole. Many texts are encoded in groups: Arrow cuts them and finds the different pieces, each
is looked up once, and Arrow puts the ids in place.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from talus.llm.common import per_process

END_ID = 2
MEMORY = 800_000  # pieces, and pre-tokens, remembered per process; those not asked for lately go first
SHORT = 64  # characters
GROUP = 8 << 20  # characters that are encoded together; a longer text is a group of its own
_ODD = f" [{''.join(c for c in map(chr, range(0x3001)) if c.isspace())}]| $"  # for `re` and for Arrow alike


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_id = attrgetter("id")


class _Memory(dict):
    """What was asked for lately. When half of `MEMORY` is full, what it holds becomes `older` and what was older goes; what
    is asked for again comes back from there, so frequent keys stay."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self) > MEMORY // 2:
            self.older = dict(self)
            self.clear()


class _Words(_Memory):
    """Pre-token -> ids, from the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()
        self.space = self.letters[32]

    def ids(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            tokens = self.tokenize(word.replace(" ", self.space))
        else:
            tokens = self.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("I", map(_id, tokens)).tobytes()

    def of_letters(self, word: str) -> bytes:
        """Ids of a word of letters with a space before it."""
        own = self.space + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array("I", map(_id, self.tokenize(own))).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.older.get(word) or self.ids(word)
        return ids


class _Pieces(_Memory):
    """Piece (the space before it left off) -> ids. Pieces of letters are one pre-token and are remembered here alone; pieces of
    letters and marks behind them are put together from the two and are not remembered."""

    def __init__(self, words: _Words, pattern: str):
        super().__init__()
        import regex

        self.words, self.split = words, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(punctuation)
        if not word.isalpha():
            ids = self[piece] = self.older.get(piece) or self.joined(" " + piece)
        elif len(word) < len(piece):
            ids = self[word] + self.words[piece[len(word) :]]
        else:
            ids = self[piece] = self.older.get(piece) or self.words.of_letters(piece)
        return ids

    def joined(self, text: str) -> bytes:
        """Ids of a text whose pre-tokens are looked up one by one."""
        return b"".join([self[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in self.split(text)])


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. Special tokens' strings are ordinary text.

    New pieces are split into pre-tokens by the vocabulary's pattern, and the library's model gives the ids of the
    pre-tokens that are new as well.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pieces = _Pieces(_Words(self.library.model), public_tokenizers.PATTERN)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if re.search(_ODD, text):
            return self._whole(text)
        self._forget()
        first, *rest = text.split(" ")
        return self._first(first) + b"".join(map(self.pieces.__getitem__, rest))

    def _first(self, piece: str) -> bytes:
        """Ids of what stands before a text's first space. Long ones are not looked up by parts, which would be remembered."""
        return self.pieces.joined(piece) if len(piece) < SHORT else self._whole(piece)

    def _forget(self) -> None:
        for memory in (self.pieces, self.pieces.words):
            memory.turn()

    def encode_all(self, rows: Iterable[tuple], group: int = GROUP) -> Iterator[tuple]:
        """(key, ids) for each (key, text), in the same order; the ids are those of `encode`."""
        keys: list = []
        held: list[str] = []
        size = 0
        for key, text in rows:
            if size + len(text) > group and held:
                yield from zip(keys, self._group(held))
                keys, held, size = [], [], 0
            keys.append(key)
            held.append(text)
            size += len(text)
        if held:
            yield from zip(keys, self._group(held))

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        self._forget()
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, _ODD)
        cut = pc.split_pattern(pc.if_else(odd, "", whole), " ")
        bounds, pieces = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = pa.array(list(map(self.pieces.__getitem__, different)), pa.large_binary())
        placed = known.take(pieces.indices)
        _, starts, data = placed.buffers()
        at, data = np.frombuffer(starts, np.int64), memoryview(data or b"")
        for text, is_odd, start, stop in zip(texts, odd.to_numpy(zero_copy_only=False), bounds[:-1], bounds[1:]):
            if is_odd:
                yield self._whole(text)
            else:  # the first piece has no space before it
                yield self._first(text.split(" ", 1)[0]) + data[at[start + 1] : at[stop]]


def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return per_process(f"pieces:{path}", lambda: PieceEncoder(path))


def with_end(ids: bytes, end_id: int = END_ID) -> bytes:
    return ids + end_id.to_bytes(4, "little")
