"""Fill-in-middle, quality rules and the manifest against brute force on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents
from pyspark.sql import functions as F

from talus.llm import fill_middle, manifest, quality_rules


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ---------------------------------------------------------------------------------------


def brute_fill(doc_id, text):
    text = text or ""
    n, d = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_middle_like_slicing_strings(make):
    rows = documents() + [(i, t) for i in range(6000, 6040) for t in ("aé日😀z" * (i % 9), "<<P>x", "a<M", "<S<P", "M>a<", "plain ascii text")]
    got = Counter(tuple(r) for r in fill_middle.report(make(rows)).collect())
    assert got == Counter(brute_fill(*row) for row in rows)
    forms = Counter(r[2] for r in got.elements())
    assert forms["psm"] > forms["spm"] > 0 and forms["plain"] > 0


def test_fill_middle_of_no_rows_and_of_texts_beyond_a_slice(make, monkeypatch):
    assert fill_middle.report(make([])).count() == 0
    assert fill_middle.report(make([])).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = [(i, ("ä" * 300_000 + "b" * 300_000) * (1 + i % 8)) for i in range(10)]
    assert Counter(tuple(r) for r in fill_middle.report(make(rows)).collect()) == Counter(brute_fill(*row) for row in rows)


@pytest.mark.parametrize("text", ["", "ascii", "é", "日本x", "a😀b" * 5, "ää" * 40 + "z" * 40])
def test_exceptions_convert_cuts_both_ways(text, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 7)
    data = text.encode()
    index = fill_middle.Exceptions(np.frombuffer(data, np.uint8))
    points = np.arange(len(text) + 1)
    offsets = np.array([len(text[:i].encode()) for i in points])
    assert index.to_bytes(points).tolist() == offsets.tolist()
    assert index.to_points(offsets).tolist() == points.tolist()
    every = index.to_points(np.arange(len(data) + 1)).tolist()
    assert every == [len(data[:i].decode(errors="ignore")) for i in range(len(data) + 1)]
    assert len(index.points) == sum(ord(c) > 127 for c in text)


# --- quality rules --------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(doc_id, text):
    text = text or ""
    words, at = WORD.findall(text), defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for held in at.values() if len(held) > 1 for i in held for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_statistics_like_counting(make):
    loop = "one two three four five six seven eight nine "
    rows = documents() + [
        (7000, loop * 3), (7001, "a " * 30), (7002, " ".join(map(str, range(100))) + " " + loop + "x " + loop), (7003, "x\n\nx\n x\nx\n\t\n\t\n#*|<>"),
        (7004, "\x0b\x0c a\x0bb \x1f \x85 \xa0 c\r\n" * 30), (7005, "a b c d e f g h"), (7006, "a b c d e f g h a b c d e f g h"), (7007, "word " * 5000),
        (7008, "1 2 3 4 5 6 7 8 9 8 7 6 5 4 3 2 1 " * 2 + "é" * 40),
    ]
    got = quality_rules.statistics(make(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_statistics(*row) for row in rows)
    assert quality_rules.statistics(make([])).count() == 0


def label_rows(spark, n, good):
    rng = np.random.default_rng(5)
    names = list(quality_rules.features())
    values = rng.random((n, len(names)))
    rows = [(i, *map(float, v), int(good(dict(zip(names, v))))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{x} double" for x in names) + ", good int"), names, rows


def test_rules_find_conjunctions_and_agree_with_their_expression(spark):
    bad = lambda v: v["symbols_per_word"] > 0.8 and v["words"] < 0.5 or v["distinct_words"] < 0.07
    rows, names, held = label_rows(spark, 3000, lambda v: not bad(v))
    learned = quality_rules.fit(rows)
    assert learned.target == 0 and 2 <= len(learned.rules) <= quality_rules.RULES
    assert all(1 <= len(rule) <= quality_rules.CONDITIONS for rule in learned.rules)
    said = {r["doc_id"]: r["v"] for r in rows.select("doc_id", learned.verdict({n: F.col(n) for n in names}).alias("v")).collect()}

    def by_hand(v):  # first match first
        for rule in learned.rules:
            if all((v[c.feature] >= c.threshold) == c.above for c in rule):
                return learned.target
        return 1 - learned.target

    assert said == {r[0]: by_hand(dict(zip(names, r[1:-1]))) for r in held}
    assert np.mean([said[r[0]] == r[-1] for r in held]) > 0.97
    assert str(learned).splitlines()[-1] == "else: 1"


def test_rules_without_anything_to_learn(spark):
    rows, names, _ = label_rows(spark, 200, lambda v: True)
    assert quality_rules.fit(rows).rules == [] and quality_rules.fit(rows).target == 0
    assert quality_rules.fit(rows.limit(0)).rules == []
    noise, _, _ = label_rows(spark, 400, lambda v: hash(v["words"]) % 2)
    covered = quality_rules.fit(noise).rules
    assert all(len(rule) <= quality_rules.CONDITIONS for rule in covered)


def test_labels_count_by_their_worse_side_and_verdicts_respect_the_base(make, spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = make([(1, text), (2, text), (3, "short"), (4, text), (None, text)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 2, 0), (None, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality_rules.statistics(docs)
    assert {(r.doc_id, r.good) for r in quality_rules.labelled(stats, labels).collect()} == {(1, 0), (2, 1)}
    keep = quality_rules.verdicts(stats, quality_rules.DecisionList(0))
    assert Counter((r.doc_id, r.kept) for r in keep.collect()) == Counter({(1, True): 1, (2, True): 1, (3, False): 1, (4, True): 1, (None, True): 1})


def test_held_out_rows_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    from talus.llm.queries import QUERIES

    found = QUERIES["op12_quality_rules"](spark, folder).where("NOT base_failed").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    good, bad = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, True), 0) >= 0.97 * good
    assert n.get((0, False), 0) >= 0.6 * bad


# --- manifest -------------------------------------------------------------------------------------------------


def h(*parts):
    return sha("".join(parts))


def brute_tree(nodes):
    """Levels from the leaves to the top."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute_path(levels, at):
    for nodes in levels[:-1]:
        run, place = nodes[at - at % 2 : at - at % 2 + 2], at % 2
        yield place, run[:place] + run[place + 1 :]
        at //= 2


def brute_proofs(rows):
    def text(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(doc_id, source, lang, n_chars, body):
        return h(*map(text, (doc_id, source, lang, n_chars, body)))

    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    last = brute_tree([trees[x][-1][0] for x in langs])
    out = Counter()
    for at_lang, lang in enumerate(langs):
        for at, (_, _, own, row) in enumerate(sorted(by_lang[lang], key=lambda r: r[:3])):
            path = [*brute_path(trees[lang], at), *brute_path(last, at_lang)]
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf(*row[:3], row[3] + 1, row[4])
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            proof = h(*(x for _, others in path for x in others))
            out[row[0], own, trees[lang][-1][0], last[-1][0], proof, node, node == last[-1][0]] += 1
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(n=300):
    rng = np.random.default_rng(2)
    langs = [None, "en", "de", "é", "", "zz", "-", "="]
    rows = []
    for i in range(n):
        lang = langs[0 if i % 3 else rng.integers(len(langs))] if i % 2 else "en"
        rows.append((int(rng.integers(-(1 << 40), 1 << 40)) if i % 5 == 0 else i, ["a", None, "ü"][i % 3], lang, None if i % 11 == 0 else i, None if i % 13 == 0 else f"text {i}"))
    rows += [(None, "s", "en", 1, "x"), (None, None, None, None, None), (None, "s", "en", 1, "x"), (None, "s", "en", 2, "y")]  # null ids, and the same row twice
    rows += [(5, "s", "en", 3, "other text of an id")] * 3 + [((1 << 63) - 1, "s", "en", (1 << 63) - 1, "x"), (-(1 << 63), "s", "en", 0, "x"), (77, "s", "lone", 1, "only leaf")]
    return rows


def test_proofs_like_a_tree_of_lists(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("at", "tree", "bucket", "place", "row", "leaf", "node", "n", "block", "path", "many", "share", "rank"):
        docs = docs.withColumn(name, F.lit("x"))
    assert Counter(tuple(r) for r in manifest.proofs(docs).collect()) == brute_proofs(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_proofs_of_few_rows(spark, n):
    rows = [(i, None, f"l{i % 2}", 7, "t") for i in range(n)]
    assert Counter(tuple(r) for r in manifest.proofs(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_proofs(rows)


def test_proofs_over_several_rounds_of_blocks_and_dense_containers(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 3)  # eight slots to a block
    rows = [(i * 2, "s", "en" if i % 3 else None, i, "t") for i in range(1500)] + [(i, None, "de", None, None) for i in range(9)] + [(100, "s", "en", i, "again") for i in range(60)]
    assert Counter(tuple(r) for r in manifest.proofs(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()) == brute_proofs(rows)


def test_a_crowded_id_is_dealt_to_several_tasks(spark):
    rows = spark.range(9000).selectExpr("if(id < 8800, 3, id) AS doc_id", "'s' AS source", "'en' AS lang", "id AS n_chars", "'t' AS text")
    at = manifest.coordinates(manifest.leaves(rows))
    assert at.agg(F.count_distinct("at"), F.min("at"), F.max("at")).first()[:] == (9000, 0, 8999)
    assert at.where("doc_id = 3").agg(F.min("at"), F.max("at")).first()[:] == (0, 8799)


def test_proofs_of_no_rows(spark):
    found = manifest.proofs(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 4096])
def test_container_ranks(n):
    rng = np.random.default_rng(n)
    places = np.sort(rng.choice(4096, n, replace=False)).astype(np.int32)
    drawn = np.concatenate([places, places[: n // 3], places[: n // 5]])
    rng.shuffle(drawn)
    held = manifest.Container.from_bytes(manifest.Container.of(drawn, np.ones(len(drawn))).to_bytes())
    assert held.rows() == len(drawn)
    found, many = held.ranker()(places)
    assert found.tolist() == [int((drawn < p).sum()) for p in places]
    assert many.tolist() == [int((drawn == p).sum()) > 1 for p in places]
    at, counts = held.places()
    assert at.tolist() == places.tolist() and counts.sum() == len(drawn)
