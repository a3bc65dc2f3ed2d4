"""Toxicity, page text and chat formatting: held-out quality, layouts, event logs, odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import prose

from talus.llm import boosting, chat, page_text, toxicity

SF = "/root/testdata/sf0.001"


def toxic_rows(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200)).split()
        label = i % 4 == 0
        for _ in range(4 if label else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilebad", "grumscum", "rottenhead"]))
        rows.append((" ".join(words).encode(), int(label)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(toxic_rows())


def test_toxicity_held_out(model):
    score = model.scorer()
    rows = toxic_rows(seed=2)
    got = np.array([score(t) for t, _ in rows])
    label = np.array([y for _, y in rows])
    assert ((got >= 0.5) == label).mean() > 0.95
    assert got.min() >= 0 and got.max() <= 1


def test_toxicity_of_odd_rows(make, model):
    rows = [(1, None), (2, ""), (None, "vilebad grumscum"), (3, "x" * 200_000), (4, "é\x00"), (4, "é\x00")]
    got = toxicity.score(make(rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    docs = make(rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.drop_toxic(make([]), model).collect() == []
    few = toxicity.fit([(b"a", 1), (b"b", 0)])
    assert 0 <= few.scorer()(b"anything") <= 1 and 0 <= toxicity.fit([]).scorer()(b"") <= 1


def test_windows_cover_the_text():
    text = bytes(range(97, 123)) * 37
    covered = set()
    for i, w in enumerate(toxicity.windows(text)):
        assert text[i * toxicity.STEP :].startswith(w)
        covered |= set(range(i * toxicity.STEP, i * toxicity.STEP + len(w)))
    assert covered == set(range(len(text)))


def dense_rows(n, seed):
    """Texts whose class is told by how many of their words begin with one stem, which the other class has now and then."""
    rng, rows = np.random.default_rng(seed), []
    ends = ["ling", "ter", "mar", "os", "ibe", "unt", "ach"]
    for i in range(n):
        toxic = i % 4 == 0
        words = []
        for _ in range(int(rng.integers(150, 400))):
            cue = rng.random() < (0.04 if toxic else 0.003)
            parts = ["zorbel"] if cue else list(rng.choice(["gra", "nem", "olu", "tis", "per", "ako", "zo", "be"], 2))
            words.append("".join([*parts, rng.choice(ends)]))
        rows.append((" ".join(words).encode(), int(toxic)))
    return rows


def test_a_class_told_by_density():
    of = toxicity.fit(dense_rows(900, 1)).scorer()
    scores = [(of(text), y) for text, y in dense_rows(400, 2)]
    hit, miss = [[s >= 0.5 for s, y in scores if y == kind] for kind in (1, 0)]
    assert np.mean(hit) > 0.85 and np.mean(miss) < 0.04


def test_cues_behind_the_first_windows_are_learnt():
    rows = toxic_rows()
    rng = random.Random(5)
    late = [(prose(rng, 800).encode() + b" " + text if y else text, y) for text, y in rows]  # over 6,000 bytes before the cue
    held, n = toxicity.some_windows(late[0][0])
    assert len(held) == min(n, toxicity.MAX_WINDOWS) and n == len(toxicity.windows(late[0][0]))
    of = toxicity.fit(late).scorer()
    told = [of(text) for text, y in rows if y]
    assert np.mean(np.array(told) >= 0.5) > 0.8


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    got = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


@pytest.fixture(scope="module")
def trees(spark):
    return page_text.fit(page_text.sample(spark.read.parquet(f"{SF}/pages.parquet")))


SENTENCE = "A sentence of the story, with words and more of them. "
BODY = "".join(f"<p>{SENTENCE * k}</p>" for k in (3, 5, 2, 6))
LINES = [(SENTENCE * k).strip() for k in (3, 5, 2, 6)]


@pytest.mark.parametrize("html", [
    f"<body><nav><a href=/>Home</a></nav><article>{BODY}<div class=ad>Buy cheap things.</div><section class=comments><p>I read it and think so.</p></section></article><footer>All rights.</footer>",
    f'<html><head><title>x</title><style>p{{}}</style></head><body><div class="menu"><a href=1>A</a> <a href=2>B</a></div><div class="story">{BODY}</div>'
    f'<div class="sidebar"><p>Read this too.</p></div><form>Name <input></form><div class="footer">Imprint.</div></body></html>',
    f"<body><header><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></header><main>{BODY}<script>var x='<p>no</p>'</script></main><aside>Side note.</aside>",
])
def test_layouts(trees, html):
    assert page_text.main_text(html, trees).split("\n\n") == LINES


@pytest.mark.parametrize("html, text", [
    ("<body><nav><a href=/>Home</a></nav><article>" + "<br>".join([SENTENCE] * 8) + "</article><footer>All rights.</footer></body>", " ".join([SENTENCE.strip()] * 8)),
    ("<body><div class=header>Site name</div>" + f"<p>{SENTENCE * 4}</p>" * 3 + "<div class=footer>Imprint and so on.</div></body>", "\n\n".join([(SENTENCE * 4).strip()] * 3)),
    (f"<body><article><p>{SENTENCE * 4}</p></article><div class=comment>I read it and think so.</div></body>", (SENTENCE * 4).strip()),
])
def test_lines_in_one_block_flat_pages_and_single_paragraphs(trees, html, text):
    assert page_text.main_text(html, trees) == text


def labellings(block, state):
    """Every consistent labelling of a block's subtree, as (blocks with their state, score without odds)."""
    below = [[]] if not block.children else None
    if below is None:
        allowed = {"out": ("out", "in"), "in": ("in", "cut"), "cut": ("cut",)}[state]
        below = [[]]
        for child in block.children:
            below = [b + [(s, rest)] for b in below for s in allowed for rest in labellings(child, s)]
    for parts in below:
        cost, before, held = 0.0, "out", [(block, state)]
        for s, (rest, own) in parts:
            cost += own
            if state == "out" and s == "in" and before != "in":
                cost -= page_text.ENTER
            if state == "in" and s == "cut":
                cost -= page_text.CUT
            before = s
            held += rest
        yield held, cost


def test_decoding_against_all_labellings():
    rng = random.Random(6)
    for _ in range(120):
        html, open_ = "", []
        for _ in range(rng.randint(1, 6)):  # a random tree of at most six blocks below the root
            while open_ and rng.random() < 0.5:
                html += f"</{open_.pop()}>"
            html += "<div>x"
            open_.append("div")
        blocks = page_text.parse(html)
        odds = np.array([rng.gauss(0.5, 3) for _ in blocks])
        number = {id(b): i for i, b in enumerate(blocks)}

        def worth(held, cost):
            return cost + sum(odds[number[id(b)]] for b, s in held if s == "in")

        every = [(worth(h, c - (page_text.ENTER if s == "in" else 0)), {number[id(b)] for b, x in h if x == "in"}) for s in ("out", "in") for h, c in labellings(blocks[0], s)]
        best = max(w for w, _ in every)
        got = {i for i, yes in enumerate(page_text.decode(blocks, odds, page_text.ENTER)) if yes}
        if best > 1e-9:
            assert any(abs(w - best) < 1e-9 and inside == got for w, inside in every)
        else:  # nothing outweighs its start: then without that cost
            assert not got or all(odds[i] > 0 for i in got if blocks[i].parent is None or number[id(blocks[i].parent)] not in got and not blocks[i].children)


def test_deep_pages_are_parsed_in_proportion():
    import time

    def spent(n):
        start = time.process_time()
        page_text.parse("<div>" * n + "<p>x" * n)
        return time.process_time() - start

    assert spent(40_000) < 12 * max(spent(10_000), 0.02)


def test_an_article_behind_60000_characters_is_learnt_from(spark):
    late = "<body><!-- " + "x" * 70_000 + f" --><article>{BODY}</article></body>"
    pages = spark.createDataFrame([(i, "u", late) for i in range(30)], "page_id long, url string, html string")
    assert page_text.sample(pages) == [late] * page_text.LONG_PAGES


def test_children_of_a_wide_page_keep_their_own_place():
    blocks = page_text.parse("<body>" + "".join(f"<p>{'x' * (i + 1)}</p>" for i in range(80)) + "</body>")
    rows = page_text.features(blocks)
    wide = next(b for b in blocks if len(b.children) == 80)
    own = [i for i, b in enumerate(blocks) if b.parent is wide]
    assert rows[own, 2].tolist() == list(range(80))
    sizes = [b.text for b in wide.children]
    assert np.allclose(rows[own, 11], [sum(sizes[max(0, k - 1) : k + 2]) / sum(sizes) for k in range(80)])


def test_rare_markup_is_found_and_tables_without_any_have_texts(spark):
    old = f'<body><div class="menu"><a href=1>A</a> <a href=2>B</a></div><div class="story">{BODY}</div><div class="footer">Imprint.</div></body>'
    script = f"<body><!-- <article> --><script>var x = '<main>'</script><div>{BODY}</div></body>"
    told = f"<body><nav><a href=/>Home</a></nav><article>{BODY}</article></body>"
    rows = [(i, "u", told if i % 400 == 7 else script if i % 2 else old) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert page_text.sample(pages) == [told] * 5
    none = pages.where("page_id % 400 != 7").limit(50)
    assert page_text.sample(none) == []
    got = page_text.extract(none.where("page_id % 2 = 0"), page_text.fitted(none)).collect()
    assert got and all(r.text.split("\n\n") == LINES for r in got)


def test_markup_inside_blocks():
    html = "<article><h1>T &amp; t</h1><p><b>one<br>two <i>th</i>ree<p>a &lt; b &#233;&nbsp; c<!-- x --><p>x < y</article>"
    blocks = page_text.parse(html)
    assert page_text.text_of(blocks, np.ones(len(blocks), dtype=bool)) == "T & t\n\none two three\n\na < b é c\n\nx < y"


def test_page_rows(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<a href='x>never closed"), (5, "u", "<div>" * 3000 + "deep"), (None, "u", f"<article>{BODY}</article>"), (6, "u", "<!--")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r.page_id: r for r in page_text.extract(pages, trees).collect()}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[2].text == "" and got[None].text.split("\n\n") == LINES
    assert page_text.extract(pages.limit(0), trees).collect() == []
    assert page_text.fit(["<p>no article</p>"]) is None and page_text.extract(pages, None).count() == 7


def test_decoding_has_no_contradiction(trees):
    rng = np.random.default_rng(0)
    blocks = page_text.parse(f"<div><div>{BODY}<div><p>a<p>b</div></div></div>" * 5)
    for _ in range(50):
        inside = page_text.decode(blocks, rng.normal(0, 4, len(blocks)))
        state = dict(zip(map(id, blocks), inside))
        for b in blocks:  # a block inside below one that is not is where an article starts: nothing above is inside
            if state[id(b)] and b.parent is not None and not state[id(b.parent)]:
                up = b.parent
                while up is not None:
                    assert not state[id(up)]
                    up = up.parent


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    fitted = boosting.fit(x[:1000], y[:1000])
    assert ((fitted.log_odds(x[1000:]) > 0) == y[1000:]).mean() > 0.95


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_event_log(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", "assistant", "Hel"), (1, 4, 1, "delta", "assistant", "lo"),
        (1, 5, 2, "message", "user", "bye"), (1, 6, 0, "edit", "user", "hi there"), (1, 7, 1, "regenerate", "assistant", "New"), (1, 8, 1, "delta", "assistant", "er"),
        (2, 1, 0, "delta", "user", "no"), (2, 2, 0, "delta", "user", " start"), (2, 3, 0, "unknown", "user", "x"), (3, 1, 0, None, None, None),
    ]
    got = [tuple(r) for r in chat.final_messages(log(spark, rows)).orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text").collect()]
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "Newer"), (2, 0, "user", "no start"), (3, 0, "", "")]


def test_chat_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "\\", "\\<", "a\\\\[b", "", None, "é日本😀\n", "<|", "$1 \\1"]
    rows = [(i, t, role, text) for i in range(3) for t, (role, text) in enumerate((r, x) for x in bad for r in ("user", "assistant", "<|end|>"))]
    rows += [(None, 0, "assistant", "x"), (7, 3, "user", "same turn"), (7, 3, "assistant", "same turn"), (7, 3, "assistant", "same turn"), (7, None, None, "q")]
    got = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS kind", "3 AS nr")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        told = "".join(f"{r}\n{x}\n" for _, r, x in own)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
