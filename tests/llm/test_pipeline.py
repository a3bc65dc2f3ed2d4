"""The pipeline on a small folder, stage by stage against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import prose
from test_text_operators import brute_repeats, lower
from tokenizers import Tokenizer

import corpus_pipeline
from talus.llm import tokens
from talus.llm.common import stored

BAD = ["vilebad", "grumscum", "rottenhead"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(8), [], []
    for i in range(300):
        words = prose(rng, rng.randint(60, 160)).split()
        if i % 5 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        labels.append((i, int(i % 5 == 0)))
        rows.append((i, " ".join(words)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, clean[k][1].upper() if k % 2 else clean[k][1]) for k in range(10)]  # exact copies
    for k in range(10):  # near copies
        words = clean[20 + k][1].split()
        words[7] = "edited"
        rows.append((2000 + k, " ".join(words)))
    passage = prose(rng, 15)
    rows += [(3000 + k, f"{prose(rng, 50)} {passage} {prose(rng, 50)}") for k in range(10)]
    rows += [(4000, None), (4001, ""), (4002, prose(rng, 4000)), (None, prose(rng, 70)), (4003, rows[201][1]), (4003, rows[201][1])]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 AS quality").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = held[name] = stored(stage(spark, docs, folder), f"test-{name}")
    columns = held["documents"].columns
    assert all(held[name].columns == columns for name, _ in corpus_pipeline.STAGES[:-1])
    rows = {name: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for name, df in held.items() if name != "packing"}

    # toxic documents go, clean ones stay
    gone = Counter(rows["documents"]) - Counter(rows["toxicity"])
    toxic = {i for i, t in rows["documents"] if any(w in (t or "") for w in BAD)}
    assert {i for i, _ in gone} <= toxic and len({i for i, _ in gone}) > 0.9 * len(toxic)

    # of equal texts the largest id stays
    best = {}
    for i, t in rows["toxicity"]:
        key = lower(t)
        best[key] = i if key not in best or best[key] is None else best[key] if i is None else max(best[key], i)
    assert Counter((i, lower(t)) for i, t in rows["exact_dedup"]) == Counter((i, t) for t, i in best.items())

    # of near copies the smallest id stays, everything else stays
    def shingles(text):
        w = lower(text).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = {i for i, _ in rows["near_dedup"]}
    sets = {i: shingles(t) for i, t in rows["exact_dedup"] if i is not None}
    for i in sets:
        close = [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) and sets[i]]
        if not close or i < min(close):
            assert i in kept
    assert not kept & {2000 + k for k in range(10)}

    # passages: byte for byte, but for characters that were cut
    want = {i: (n_bytes - n_removed, digest) for i, n_bytes, n_removed, _, digest in brute_repeats(rows["near_dedup"])}
    for r in held["suffix_dedup"].collect():
        size, digest = want[r.doc_id]
        data = r.text.encode()
        assert hashlib.sha256(data).hexdigest() == digest or size - 8 <= len(data) < size
        assert r.n_chars == len(r.text)
    assert len(rows["suffix_dedup"]) == len(rows["near_dedup"])

    # packing: all tokens, each once, no sequence over 1024
    made = Tokenizer.from_file(tokens.vocabulary())
    total = {i: len(made.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows["suffix_dedup"]}
    pieces, fill = Counter(), Counter()
    for r in held["packing"].collect():
        pieces[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert pieces == Counter(total) and max(fill.values()) <= 1024
    assert len(fill) <= np.ceil(sum(total.values()) / 1024) * 1.2 + 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
