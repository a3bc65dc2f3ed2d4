"""Exact dedup, suffix dedup, SimHash and winnowing against brute force on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import documents
from pyspark.sql import functions as F

from talus.llm import exact_dedup, simhash, suffix_dedup, winnowing


def lower(text):
    return (text or "").encode().lower()


def test_exact_groups(make):
    rows = documents()
    got = exact_dedup.exact_groups(make(rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        known = [x for x in groups[lower(t)] if x is not None]
        keep = max(known) if known else None
        want[i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t)).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_groups_of_long_texts_that_differ_late(make):
    head = "long text " * 900
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "A"), (4, head), (5, head.upper())]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(make(rows)).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (5, 2), 5: (5, 2)}


def test_drop_exact_keeps_columns_and_one_row_of_a_group(make):
    rows = documents()
    docs = make(rows)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter({lower(t): 1 for _, t in rows})


def brute_repeats(rows, length=50):
    least = {}
    for i, t in rows:
        b, i = (t or "").encode(), -(1 << 63) if i is None else i
        for p in range(len(b) - length + 1):
            least[b[p : p + length]] = min(i, least.get(b[p : p + length], i))
    for i, t in rows:
        b, k = (t or "").encode(), -(1 << 63) if i is None else i
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < k:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [1, 4096])  # 1: every shared passage goes window by window
def test_suffix_repeats(make, hot):
    rows = documents()
    got = suffix_dedup.repeats(make(rows), runs=5, parts=3, hot=hot).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(rows))
    assert sum(r.n_removed for r in got) > 5000


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_repeats_with_more_parts_than_entries_of_a_run(make, hot):
    rows = documents()
    got = suffix_dedup.repeats(make(rows), runs=20, parts=3000, hot=hot).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_repeats(rows))


def test_suffix_fragments_grow_with_the_table():
    for total in (1 << 30, 2 << 30, 4 << 30):
        size = suffix_dedup.bytes_of_run(total)
        assert size <= suffix_dedup.MOST_BYTES
        assert (total / size) ** 2 <= 1.01 * total / suffix_dedup.FRAGMENT_BYTES
    assert suffix_dedup.bytes_of_run(100 << 30) == suffix_dedup.MOST_BYTES
    assert suffix_dedup.bytes_of_run(0) == suffix_dedup.bytes_of_run(1 << 28) == suffix_dedup.RUN_BYTES


def suffix_run(docs):
    return suffix_dedup.Run(pa.table({"run": pa.array([0], pa.int32()), "docs": pa.array([suffix_dedup.pack(docs)], pa.binary())}))


def test_suffix_entries_are_sorted_once_not_part_by_part(monkeypatch):
    rng = random.Random(8)
    run = suffix_run([(i, 0, rng.randbytes(3000)) for i in range(50)])
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: (calls.append(1), sort(*a, **b))[1])

    def sorts(parts):
        calls.clear()
        list(run.entries(parts, {p: (b"\xff" * 8000, bytes(8000)) for p in range(parts)}))
        return len(calls)

    assert sorts(500) == sorts(2)


def test_suffix_anchors_are_not_met_by_shorter_strings():
    rng = random.Random(9)
    phrases = [rng.randbytes(20) for _ in range(100)]
    docs = [(i, 0, b"".join(p + rng.randbytes(10) for p in phrases)) for i in range(2)]
    passage = rng.randbytes(80)
    hashes = lambda texts: [set(suffix_run([(0, 0, t)]).hash.tolist()) for t in texts]
    one, other = hashes(t for *_, t in docs)
    assert one and not one & other
    one, other = hashes(t[:1000] + passage + t[1000:] for *_, t in docs)
    assert one & other


def test_suffix_anchors_and_stretches_against_every_window():
    rng = random.Random(10)
    run = suffix_run([(i, 0, bytes(rng.choices(b"ab", k=rng.randrange(200))) if i % 2 else b"xyz" * rng.randrange(60)) for i in range(60)])
    anchors, least, span = set(), {}, suffix_dedup.SPAN
    for a, b in zip(run.starts.tolist(), run.ends.tolist()):
        order = suffix_dedup._gram_order(run.data[a:b]).tolist() if b - a >= suffix_dedup.LENGTH else []
        for s in range(len(order) - span + 1):
            least[a + s] = low = min(order[s : s + span])
            anchors |= {a + s + o for o in range(span) if order[s + o] == low}
    assert run.at.tolist() == sorted(anchors)
    assert {s: v for a, b, v in zip(run.head.tolist(), run.tail.tolist(), run.least.tolist()) for s in range(a, b + 1)} == least


def test_suffix_keys_are_decoded_in_blocks():
    rng = np.random.default_rng(6)
    keys = np.sort(rng.integers(0, 3, (3 * suffix_dedup.DECODED + 7, suffix_dedup.KEY), dtype=np.uint8).view(f"V{suffix_dedup.KEY}").ravel())
    keys = keys.view(np.uint8).reshape(-1, suffix_dedup.KEY)
    lengths, back = suffix_dedup.front_decode(*suffix_dedup.front_code(keys, np.array([0, 5, suffix_dedup.DECODED])))
    assert (back == keys).all() and not lengths[[0, 5, suffix_dedup.DECODED]].any()


def test_drop_repeats_text_and_columns(make):
    rows = documents()
    docs = make(rows)
    new = suffix_dedup.drop_repeats(docs)
    assert new.columns == docs.columns
    got = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in new.collect())
    want = Counter((i, digest) for i, _, _, _, digest in brute_repeats(rows))
    assert sum(got.values()) == len(rows)
    assert sum((want & got).values()) > len(rows) - 15  # cut characters change a text beyond its bytes


def test_merge_runs_matches_sorting():
    rng = np.random.default_rng(5)
    runs = []
    for _ in range(7):
        keys = sorted({bytes(rng.integers(97, 99, suffix_dedup.KEY, dtype=np.uint8)) for _ in range(rng.integers(0, 40))} | {b"b" * suffix_dedup.KEY})
        matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, suffix_dedup.KEY)
        lengths, back = suffix_dedup.front_decode(*suffix_dedup.front_code(matrix))
        assert (back == matrix).all()
        runs.append((keys, lengths.tolist()))
    order, place, shared = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][p] for r, p in zip(order, place)]
    assert merged == sorted(k for keys, _ in runs for k in keys)
    for a, b, n in zip(merged, merged[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])


def brute_print(text, words=3):
    held = lower(text).split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(held[i : i + words]), 42) for i in range(max(1, len(held) - words + 1))] if held else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes, close):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_groups(make):
    rows = documents()
    got = simhash.near_groups(make(rows)).collect()
    prints = {(i, t): brute_print(t) for i, t in rows}
    root = components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{prints[i, t]:016x}", least.get(root[prints[i, t]])) for i, t in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("hot", [2, 64])
def test_simhash_links_have_every_component(spark, hot):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot=hot)
    labels = {r.fp: r.label for r in simhash.components(edges).collect()}
    want = components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {p: labels.get(p, p) for p in signed} == want


@pytest.mark.parametrize("hot", [2, 32])
def test_similar_groups_find_near_copies_and_leave_others(make, hot):
    rows = [r for r in documents() if r[0] is not None and r[0] < 5000]
    got = {r.doc_id: r.keep_id for r in simhash.similar_groups(make(rows), hot=hot).collect()}
    near = [i for i, _ in rows if 2000 <= i < 2010]
    assert {got[i] for i in near} == {35}  # copies of the sixth text with one word edited
    assert all(got[i] == i for i, _ in rows if 3000 <= i < 3010)  # a shared passage is no copy
    kept = simhash.drop_similar(make(documents()), hot=hot)
    assert {r.doc_id for r in kept.collect()} >= {35, 3000, None}




def test_winnowing_guarantee_and_values(spark, make):
    rows = documents()
    got = {}
    for r in winnowing.edited_report(make([r for r in rows if r[0] is not None])).collect():
        got.setdefault(r.doc_id, r)
    order = sorted(((i, t or "") for i, t in rows if i is not None))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        if i == 5000 or i == order[-1][0]:
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if half == 0 or nxt[:half] == t[len(t) - half :]:
            assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
    assert got[0].fingerprint == got[1000].fingerprint


def test_winnowing_minima_are_rightmost(spark):
    from pyspark.sql import functions as F

    text = "a b c d e f a b c d e f a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(
        winnowing.chosen(F.col("text")).alias("chosen"),
        winnowing.let(winnowing._units(F.col("text")), lambda u: winnowing._hashes(u, winnowing.K)).alias("hashes"),
    ).first()
    keyed = [(h & ~winnowing.LOW, -i) for i, h in enumerate(row.hashes)]
    want = {-min(keyed[i : i + winnowing.WINDOW])[1] for i in range(len(keyed) - winnowing.WINDOW + 1)}
    assert {c.position for c in row.chosen} == want
    assert all(row.hashes[c.position] == c.hash for c in row.chosen)


def test_empty_tables(make):
    none = make([])
    for made in (
        exact_dedup.exact_groups(none), exact_dedup.drop_exact(none), suffix_dedup.repeats(none), suffix_dedup.drop_repeats(none),
        simhash.near_groups(none), simhash.similar_groups(none), winnowing.edited_report(none),
    ):
        assert made.collect() == []


CLASHES = ("group_size", "keep_id", "_keep_id", "kept_id", "_kept_id", "tag", "kept_tag", "_keep_tag", "kept_row", "kept_text", "new_id", "_new", "new_text", "new_tag", "keep", "_keep", "g_id", "label", "text_sha256")


def test_stages_keep_multisets_and_clashing_columns(spark):
    passage = "a passage of words that two documents share and that is longer than fifty bytes"
    rows = [(1, "abc", "x"), (1, "abc", "y"), (2, "ABC", "x"), (3, f"{passage} one", "x"), (4, f"{passage} two", "x"), (4, f"{passage} two", "y"), (None, "n", "x"), (0, "n", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(7))
    exact = exact_dedup.drop_exact(docs)
    assert exact.columns == docs.columns
    # of equal texts one row of the largest id stays; of rows that repeat that id, the smallest
    assert sorted((r.doc_id, r.own) for r in exact.collect()) == [(0, "y"), (2, "x"), (3, "x"), (4, "x")]
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns
    got = Counter((r.doc_id, r.own, r.text) for r in cut.collect())
    assert got == Counter({(1, "x", "abc"): 1, (1, "y", "abc"): 1, (2, "x", "ABC"): 1, (3, "x", f"{passage} one"): 1,
                           (4, "x", "two"): 1, (4, "y", "two"): 1, (None, "x", "n"): 1, (0, "y", "n"): 1})
    near = simhash.drop_similar(docs)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {None, 0, 1, 3}


def brute_winnow(text, k=winnowing.K, window=winnowing.WINDOW):
    """The set of chosen hashes, straight from the definition."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    units = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in re.findall(r"[^\x20\x09-\x0D]{1,16}", text.lower())]
    hashes = units
    if len(units) >= k:
        hashes = []
        for i in range(len(units) - k + 1):
            h = 42
            for u in units[i : i + k]:
                h = xxhash.xxh64_intdigest(u.to_bytes(8, "little", signed=True), h)
            hashes.append(signed(h))
    if len(hashes) < window:
        return set(hashes)
    return {hashes[max(range(i, i + window), key=lambda p: (-(hashes[p] & ~winnowing.LOW), p))] for i in range(len(hashes) - window + 1)}


def test_likeness_like_sets_of_brute_force(make):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(i * 300, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 5, 8, 60, 200])))) for i in range(40)]
    rows += [(20_000 + i, rows[i][1]) for i in range(5)] + [(30_000, rows[6][1] + " more"), (30_001, "unbroken" * 30)]
    order = sorted(rows)
    got = {r.doc_id: r for r in winnowing.edited_report(make(rows)).collect()}

    def likeness(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    prints = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own = brute_winnow(text)
        assert got[i].near_edited == pytest.approx(likeness(own, brute_winnow(edited)))
        assert got[i].near_next == pytest.approx(likeness(own, brute_winnow(after)))
        prints.setdefault(frozenset(own), set()).add(got[i].fingerprint)
        prints.setdefault(frozenset(brute_winnow(edited)), set()).add(got[i].edited_fingerprint)
    assert all(len(found) == 1 for found in prints.values()) and len({x for f in prints.values() for x in f}) == len(prints)
