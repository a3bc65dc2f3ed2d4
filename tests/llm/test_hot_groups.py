"""Near duplicates in crowded blocks: chains of edits must stay one group."""

import random
from collections import Counter

import numpy as np
import pytest

from talus.llm import simhash


@pytest.fixture
def few_parts(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", held)


def chain(rng, n, size=120, step=3):
    """Texts of which each differs from the one before in `step` words."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    made = []
    for i in range(n):
        made.append(" ".join(words))
        for at in rng.sample(range(size), step):
            words[at] = f"w{rng.randrange(10**6)}"
    return made


def brute(rows, close):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if close(rows[i], rows[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def test_closure_of_a_hot_group_is_that_of_all_pairs(few_parts):
    """Chains: most links are between rows that are far from every leader; tiles of 8 rows cut all of them."""
    spark, rng = few_parts, np.random.default_rng(4)
    rows, bits = [], rng.integers(0, 2, 256, dtype=np.uint8)
    for i in range(200):
        if i % 25 == 0:
            bits = rng.integers(0, 2, 256, dtype=np.uint8)
        bits = bits.copy()
        bits[rng.choice(256, 20, replace=False)] ^= 1
        rows.append(np.packbits(bits))
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    want = brute(rows, lambda x, y: np.bitwise_count(x ^ y).sum() <= 20)
    df = spark.createDataFrame([(1, i, bytearray(r.tobytes())) for i, r in enumerate(rows)], "group long, node long, load binary").repartition(4)
    links = simhash.closure(df, simhash._near_bits(20), tile=8)
    got = {r.fp: r.label for r in simhash.components(links).collect()}
    assert len(set(want)) == 8
    assert [got.get(i, i) for i in range(len(rows))] == want


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def test_hot_blocks_lose_no_pair(few_parts):
    """Three blocks of three bits: every block is hot, and chains of edits run far from every leader."""
    spark, rng = few_parts, random.Random(5)
    made = [t for _ in range(6) for t in chain(rng, 40, step=2)]
    rng.shuffle(made)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(docs, blocks=3, block_bits=3, hot=4).collect()}
    assert [got[i] for i in range(len(made))] == brute([shingles(t) for t in made], similar)


def test_pairs_at_the_threshold(few_parts):
    """Linked from 0.8 on, apart below; a line repeated very often does not make two texts alike."""
    spark, rng = few_parts, random.Random(6)
    rows, true = [], {}
    for k in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(184)]
        changed = list(words)
        for at in (10, 50, 90, 130, 170)[: 4 + k % 2]:  # 160 of 200 shingles are shared, or 155 of 205
            changed[at] = "edited"
        x, y = (shingles(" ".join(w)) for w in (words, changed))
        true[2 * k] = similar(x, y)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    line = "the same line of five words more "
    rows += [(10_000 + k, line * 300 + " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(docs).collect()}
    at, below = ([i for i in true if true[i] == kind] for kind in (True, False))
    assert min(len(at), len(below)) >= 150
    linked = {kind: sum(got[i + 1] == i for i in held) / len(held) for kind, held in (("at", at), ("below", below))}
    print(linked)
    assert linked["at"] >= 0.97 and linked["below"] == 0
    assert all(got[10_000 + k] == 10_000 + k for k in range(20))


def test_pairs_of_short_texts(few_parts):
    """Eight words and the same with a ninth are similar to exactly 0.8; few shingles scatter more, so more pairs are lost."""
    spark, rng = few_parts, random.Random(7)
    rows = []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(docs).collect()}
    linked = sum(got[2 * k + 1] == 2 * k for k in range(300)) / 300
    print(linked)
    assert linked >= 0.87


def test_rounds_of_components_read_little_more_than_the_edges(few_parts, monkeypatch):
    """Cliques that a path joins: edges drop out round by round; a path in order of its nodes needs few rounds."""
    spark, rng = few_parts, random.Random(8)
    edges = [(max(x, y), min(x, y)) for k in range(12) for x in range(20 * k, 20 * k + 20) for y in range(20 * k, x)]
    edges += [(20 * k + 20, 20 * k) for k in range(5)] + [(1001 + i, 1000 + i) for i in range(300)] + [(5000, 5000)]
    names = list(range(300))
    rng.shuffle(names)
    edges += [(max(x, y) + 2000, min(x, y) + 2000) for x, y in zip(names, names[1:])]
    read, stored = Counter(), simhash.stored

    def counted(df, label):
        df = stored(df, label)
        read[label, "rounds"] += 1
        read[label, "rows"] += df.count()
        return df

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.fp: r.label for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    want = {i: 0 if i < 120 else i // 20 * 20 for i in range(240)} | {1000 + i: 1000 for i in range(301)} | {2000 + i: 2000 for i in range(300)} | {5000: 5000}
    assert got == want
    assert read["component-edges", "rows"] < 1.3 * len(edges) and read["component-edges", "rounds"] <= 12


def test_what_crowded_blocks_link_is_not_paired_again(few_parts, monkeypatch):
    """Near copies of one text share some blocks with all others and some with a few."""
    spark, rng = few_parts, random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(300), 4):
            words[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    pairs, verified = [], simhash._verified

    def counted(df, *rest):
        pairs.append(df.distinct().count())
        return verified(df, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(60)] == brute([shingles(t) for _, t in rows], similar)
    assert sum(pairs) < len(rows)
