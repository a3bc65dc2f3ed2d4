"""Token files, packing and BPE against the libraries, and their odd cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from cases import documents
from tokenizers import Tokenizer

from talus.llm import byte_bpe, packing, token_files, tokens

ODD = ["", " ", "a", "a  b", " a ", "\n a", "x 's y", "a b", "<|endoftext|> b", "it's  \n\n ok", "日本 語", "a" * 5000, "ab c" * 900, "é" * 999 + " !!"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(tokens.vocabulary())
    made.encode_special_tokens = True
    return lambda text: np.array([*made.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_pieces_encode_like_the_library(library):
    made = tokens.PieceEncoder(tokens.vocabulary())
    for text in [*ODD, *[t or "" for _, t in documents()]]:
        assert tokens.with_end(made.encode(text)) == library(text).tobytes(), text[:50]


def test_token_files(make, library):
    rows = [r for r in documents() if r[0] is not None and r[0] != 5000] + [(9000 + i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_report(make(rows), tokens.vocabulary()).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = library(text)
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


@pytest.mark.parametrize("group", [1, 500, 1 << 20])
def test_groups_of_texts_have_the_ids_of_the_library(library, group):
    """A group asks once for a piece, however often it stands in its texts."""
    rows = [(i, t or "") for i, t in documents()] + [(-1, "one, two three\nfour </s> x1" + " one, two three\nfour </s> x1" * 500)] + [(-2, t) for t in ODD]
    made = tokens.PieceEncoder(tokens.vocabulary())
    asked = Counter()

    class Counted(tokens._Pieces):
        def __getitem__(self, piece):
            asked[piece] += 1
            return super().__getitem__(piece)

    made.pieces = Counted(made.pieces.words, public_tokenizers.PATTERN)
    got = [(i, tokens.with_end(ids)) for i, ids in made.encode_all(iter(rows), group)]
    assert got == [(i, library(t).tobytes()) for i, t in rows]
    assert 0 < asked["x1"] < 5 and asked["three\nfour"] < 5
    assert list(made.encode_all([], group)) == []


def _counted(made):
    """Counts what the library's model is asked for."""
    asked, words = Counter(), made.pieces.words
    tokenize = words.tokenize
    words.tokenize = lambda word: asked.update([word]) or tokenize(word)
    return asked


def test_frequent_words_stay_remembered_when_the_memory_is_full(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 40)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"so often, {' '.join(c + letters[i] + 'q' for c in letters)} often") for i in range(26)]
    made = tokens.PieceEncoder(tokens.vocabulary())
    asked = _counted(made)
    assert [(i, tokens.with_end(ids)) for i, ids in made.encode_all(iter(rows), 1)] == [(i, library(t).tobytes()) for i, t in rows]
    assert asked["Ġoften"] == 1 and asked["so"] == 1 and asked["Ġabq"] == 1
    assert max(len(m) + len(m.older) for m in (made.pieces, made.pieces.words)) < 40 + 2 * 29


def test_words_with_marks_behind_them_are_asked_for_and_remembered_once(library):
    rows = [(i, f"x tree{m} große{m} tree{m * 2} it's{m} 3{m} _{m}") for i, m in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")]
    made = tokens.PieceEncoder(tokens.vocabulary())
    asked = _counted(made)
    assert [(i, tokens.with_end(ids)) for i, ids in made.encode_all(iter(rows))] == [(i, library(t).tobytes()) for i, t in rows]
    assert asked["Ġtree"] == 1 and asked["ĠgroÃŁe"] == 1 and max(asked.values()) == 1
    assert [p for p in made.pieces if p.startswith(("tree", "große"))] == ["tree", "große"]


def test_arrow_and_re_find_the_same_places_that_cannot_be_cut():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [*(f"a {c}b" for c in chars), "a", " a", "a ", "a b ", "a\n", "a \n", "", " "]
    found = pc.match_substring_regex(pa.array(texts, pa.large_string()), tokens._ODD).to_numpy(zero_copy_only=False).tolist()
    before = re.compile(r" [\s\x1c-\x1f\x85]| $")
    assert found == [before.search(t) is not None for t in texts] == [re.search(tokens._ODD, t) is not None for t in texts]


def test_token_files_of_odd_ids_and_shuffled_reads(spark, make, tmp_path, library):
    rows = [(None, "first"), (5, "same"), (5, "id"), (-3, None)]
    index = token_files.write_records(make(rows), tokens.vocabulary(), str(tmp_path), parts=2).collect()
    shuffled = spark.createDataFrame(index[::-1])
    back = Counter((r.doc_id, bytes(r.ids)) for r in token_files.read_records(shuffled, str(tmp_path)).collect())
    assert back == Counter((i, library(t).tobytes()) for i, t in rows)
    assert [r.n_tokens for r in token_files.token_report(make([]), tokens.vocabulary()).collect()] == []


def test_damaged_records_are_refused():
    data = token_files.record(7, np.array([1, 2, 70000], dtype="<u4"))
    assert token_files.parse(data)[0] == 7 and token_files.parse(data)[1].tolist() == [1, 2, 70000]
    for at in range(len(data)):
        bad = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            token_files.parse(bad)


def test_packed_pieces(make, library):
    rows = [r for r in documents() if r[0] is not None and r[0] != 5000]
    got = packing.packed_pieces(make(rows), tokens.vocabulary()).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for doc_id, text in rows:
        ids, at = library(text), 0
        for number, r in enumerate(sorted(by[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (number, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length <= 1024 and (number == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.packed_pieces(make([]), tokens.vocabulary()).collect() == []
    assert len(packing.packed_pieces(make([(None, "a"), (3, "b"), (3, "b")]), tokens.vocabulary()).collect()) == 3


def squares(sizes, bins):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def test_local_search_only_improves():
    rng = random.Random(4)
    for trial in range(30):
        sizes = [rng.randint(1, 1000 if trial % 2 else 400) for _ in range(rng.randint(1, 300))]
        first = packing.best_fit(sizes, 1024)
        last = packing.improve(sizes, [list(b) for b in first], 1024)
        assert sorted(i for b in last for i in b) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in b) <= 1024 for b in last)
        assert len(last) <= len(first) and squares(sizes, last) >= squares(sizes, first)
        assert len(last) >= -(-sum(sizes) // 1024)


def test_local_search_empties_bins_that_best_fit_leaves():
    sizes = [6, 6, 5, 5, 4, 4]  # into bins of 10: 6+4, 6+4, 5+5
    poor = [[0], [1], [2, 4], [3, 5]]
    assert len(packing.improve(sizes, poor, 10)) == 3


@pytest.fixture(scope="module")
def reference():
    with open(byte_bpe.rank_file(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encodes_like_the_library(reference):
    made = byte_bpe.TextEncoder(byte_bpe.rank_file(), public_tokenizers.PATTERN)
    rng = random.Random(9)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "é", "日本", "😀", "12", ".", "!!", "\x00", "\t", "\xa0"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 10, 40, 400]))) for _ in range(800)]
    texts += ["".join(rng.choice(letters) for _ in range(3000)) for letters in ("thinges", "ab", "aé", "0123456789", "-=")]
    for text in texts:
        ids = made.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text[:60]
        assert made.decode(ids) == text.encode()


def test_round_trip(make, reference):
    rows = documents()
    got = Counter(tuple(r) for r in byte_bpe.round_trip(make(rows), byte_bpe.rank_file(), public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), dtype="<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    args = (byte_bpe.rank_file(), public_tokenizers.PATTERN)
    back = byte_bpe.decode(byte_bpe.encode(make(rows), *args), *args)
    assert Counter(bytes(r.text) for r in back.collect()) == Counter((t or "").encode() for _, t in rows)
    assert byte_bpe.round_trip(make([]), *args).collect() == []


def test_two_pieces_of_one_bin_enter_for_one():
    sizes = [3, 6, 5, 2]
    got = packing.improve(sizes, [[0, 1], [2, 3]], 10)  # no move, no one for one and no one for two fills the first bin
    assert sorted(sum(sizes[i] for i in b) for b in got) == [6, 10] and sorted(i for b in got for i in b) == [0, 1, 2, 3]
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(60)]
        start = packing.best_fit(sizes, 50)
        rng.shuffle(start)
        worse = [b[: len(b) // 2] for b in start if len(b) > 1] + [b[len(b) // 2 :] if len(b) > 1 else b for b in start]
        got = packing.improve(sizes, [list(b) for b in worse], 50)
        assert sorted(i for b in got for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 50 for b in got) and len(got) <= len(worse)
