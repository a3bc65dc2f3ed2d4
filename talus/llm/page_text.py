"""Main text of raw web pages: boosted trees over the page's blocks, and a decoding that respects nesting.

A page is parsed into a tree of block elements; inline elements belong to the block around them, and what is never
page text (scripts, styles, form controls, head) is left out. Each block has features of its subtree's text and link
density, its tag and attribute tokens and those of its ancestors, its depth and its siblings. Boosted trees give the
log odds that a block belongs to the article.

Decoding picks the best labelling of the whole tree among three states: outside, inside, and cut out. Outside a block
may have inside children (the article starts there; children next to each other start it together); inside a block may have
a cut-out child (an advert in the article); below a cut-out block everything is cut out. So no block contradicts its
ancestors or descendants.

There are no labelled pages. The trees are fitted on a bounded sample of pages (`MAX_PAGES`, in the order of a hash of
the id) whose own markup tells article and boilerplate apart, and on variants of these pages: their blocks set anew in
other layouts, with other tags and attributes, with side bars, notices, forms and comments taken from other pages. The
sample is chosen among all pages of the table that have such markup. Where fewer than `ENOUGH` have it, pages of built-in
layouts are added.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talus.llm import boosting

MAX_PAGES = 300  # pages fetched for fitting
MAX_CHARS, LONG_PAGES = 60_000, 20  # of pages with more characters at most so many are among them
ENOUGH = 20  # pages with telling markup from which the trees rest on them alone
ENTER, CUT = 2.0, 1.0  # log odds that starting an article, or cutting a block out of it, has to outweigh

# Element and attribute names of web pages.
BLOCKS = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("button canvas head iframe noscript object option script select style svg template textarea title".split())
CLOSES_P = BLOCKS - set("body html li dd dt td th tr tbody thead tfoot".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol menu dl table".split())
GOOD_TAGS, BAD_TAGS = set("article main".split()), set("aside dialog footer form header menu nav fieldset".split())
GOOD_TOKENS = set("article articlebody body content entry main post story text".split())
BAD_TOKENS = set(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs byline consent cookie copyright disclaimer disqus footer form gdpr header "
    "legal links login masthead menu meta modal nav navbar navigation newsletter notice notification pagination popup promo promoted related "
    "search share sharing sidebar side signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
TALK_TOKENS = set("comment comments discussion reader readers replies reply respond responses thread".split())

_TAG = r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)"
_LOOSE_TAG = r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)"  # a quote that is never closed
_ATTRIBUTE = r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


class Block:
    __slots__ = ("tag", "parent", "children", "parts", "good", "bad", "talk", "text", "link", "nodes", "marks", "paragraphs")

    def __init__(self, tag: str, parent: Block | None, tokens: set[str]):
        self.tag, self.parent, self.children = tag, parent, []
        self.parts: list[str | Block] = []  # own text and child blocks, in page order
        self.good, self.bad, self.talk = len(tokens & GOOD_TOKENS), len(tokens & BAD_TOKENS), len(tokens & TALK_TOKENS)
        self.text = self.link = self.nodes = self.marks = self.paragraphs = 0
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def _tokens(attributes: str) -> set[str]:
    found: set[str] = set()
    for value in re.findall(_ATTRIBUTE, attributes, re.I):
        words = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
        found.update(w.lower() for w in re.split(r"[^A-Za-z]+", words) if w)
    return found


def parse(html: str) -> list[Block]:
    """The blocks of a page in page order; the first is the root. End tags that are missing are supplied."""
    root = Block("html", None, set())
    blocks, open_ = [root], [root]
    held: Counter[str] = Counter()  # tags of the open blocks, so that what is not there is not looked for
    tag_at, loose_at = re.compile(_TAG).match, re.compile(_LOOSE_TAG).match
    at, links, size = 0, 0, len(html)

    def put(text: str) -> None:
        here, text = open_[-1], unescape(text)
        here.parts.append(text)
        n = len(text.strip())
        here.text += n
        here.link += n if links > 0 else 0
        here.marks += sum(map(text.count, ".!?,;"))

    def close(first: int) -> None:
        held.subtract(b.tag for b in open_[first:])
        del open_[first:]

    def last(tags: set[str]) -> int:
        return next(i for i in range(len(open_) - 1, 0, -1) if open_[i].tag in tags)

    while at < size:
        start = html.find("<", at)
        if start < 0:
            put(html[at:])
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            m, stop = None, size if end < 0 else end + 3
        elif html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            m, stop = None, size if end < 0 else end + 1
        else:
            m = tag_at(html, start) or loose_at(html, start)
            stop = m.end() if m else start + 1
            if m is None:  # a plain character
                put(html[at:stop])
                at = stop
                continue
        if start > at:
            put(html[at:start])
        at = stop
        if m is None:
            continue
        closing, tag = m[1], m[2].lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if held[tag] > 0:
                    close(last({tag}))
                    links = 0
        elif tag in SKIPPED:
            if not m[3].endswith("/"):
                rest = re.compile(rf"</{tag}\b[^>]*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(html, at)
                at = size if rest is None else rest.start() if rest[0][:5].lower() == "<body" else rest.end()
        elif tag == "a":
            links += 1
        elif tag == "br":
            open_[-1].parts.append(" ")
        elif tag in BLOCKS and tag != "html":
            if tag in CLOSES_P and held["p"] > 0:
                close(last({"p"}))
            if tag in ITEMS and any(held[t] > 0 for t in ITEMS[tag]):
                at_item = last(ITEMS[tag] | LISTS)
                if open_[at_item].tag in ITEMS[tag]:
                    close(at_item)
            block = Block(tag, open_[-1], _tokens(m[3]) if "=" in m[3] else set())
            blocks.append(block)
            open_.append(block)
            held[tag] += 1
            links = 0
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, in page order."""
    for b in reversed(blocks):  # children come after their parents
        b.nodes += 1
        b.paragraphs += b.tag == "p"
        if b.parent is not None:
            up = b.parent
            up.text, up.link, up.nodes = up.text + b.text, up.link + b.link, up.nodes + b.nodes
            up.marks, up.paragraphs = up.marks + b.marks, up.paragraphs + b.paragraphs
    page = max(blocks[0].text, 1)
    has_article = any(b.tag in GOOD_TAGS for b in blocks)
    places = {id(child): i for b in blocks for i, child in enumerate(b.children)}
    above: dict[int, tuple] = {}
    rows = []
    for b in blocks:
        up = above[id(b.parent)] if b.parent is not None else (-1, 0, 0, 0, 0, 0)
        depth, good, bad, talk, good_tag, bad_tag = up
        brothers = b.parent.children if b.parent is not None else [b]
        place = places.get(id(b), 0)
        here = (depth + 1, good + b.good, bad + b.bad, talk + b.talk, good_tag + (b.tag in GOOD_TAGS), bad_tag + (b.tag in BAD_TAGS))
        above[id(b)] = here
        around = max(b.parent.text, 1) if b.parent is not None else page
        near = [x.text for x in brothers[max(0, place - 1) : place + 2]]
        rows.append((
            depth + 1, len(b.children), place, len(brothers), np.log1p(b.text), b.text / page, b.link / max(b.text, 1), b.text / b.nodes,
            b.marks / max(b.text, 1), b.paragraphs, b.text / around, sum(near) / around, b.good > 0, b.bad > 0, b.talk > 0, good > 0, bad > 0,
            talk > 0, b.tag in GOOD_TAGS, b.tag in BAD_TAGS, good_tag > 0, bad_tag > 0, has_article, b.tag == "p", b.tag in ("li", "ul", "ol"),
            b.tag[0] == "h" and b.tag[1:].isdigit(), b.tag in ("div", "section"), b.tag in ("body", "html"),
            sum(c.tag == "p" for c in b.children), sum(c.text for c in b.children if c.tag == "p") / max(b.text, 1),
        ))
    return np.array(rows, dtype=np.float64)


def decode(blocks: list[Block], odds: np.ndarray, enter: float = ENTER) -> np.ndarray:
    """Whether each block is inside, in the best consistent labelling (see the module's text). A page whose article does not
    outweigh its start is looked at again as if starting cost nothing: it keeps doubtful second articles out, not a first."""
    number = {id(b): i for i, b in enumerate(blocks)}
    outside, inside, cut = np.zeros(len(blocks)), np.zeros(len(blocks)), np.zeros(len(blocks))

    def runs(children: list[int]) -> tuple[float, list[bool]]:
        """The best labelling of an outside block's children, of which each run inside pays `enter` once."""
        out, within, came = 0.0, -np.inf, []
        for c in children:
            starts, ends = out - enter > within, within > out
            came.append((ends, not starts))  # whether the child before was inside, if this one is outside or inside
            out, within = max(out, within) + outside[c], max(within, out - enter) + inside[c]
        now, labels = within > out, []
        for before_out, before_in in reversed(came):
            labels.append(now)
            now = before_in if now else before_out
        return max(out, within), labels[::-1]

    below = [[number[id(c)] for c in b.children] for b in blocks]
    chosen: list[list[bool]] = [[]] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        outside[i], chosen[i] = runs(below[i])
        inside[i] = odds[i] + sum(max(inside[c], cut[c] - CUT) for c in below[i])
        cut[i] = sum(cut[c] for c in below[i])  # what is not inside scores 0
    state = ["out"] * len(blocks)
    state[0] = "in" if inside[0] - enter > outside[0] else "out"
    for i in range(len(blocks)):
        for k, c in enumerate(below[i]):
            if state[i] == "out":
                state[c] = "in" if chosen[i][k] else "out"
            elif state[i] == "in":
                state[c] = "in" if inside[c] >= cut[c] - CUT else "cut"
            else:
                state[c] = "cut"
    found = np.array([s == "in" for s in state])
    return decode(blocks, odds, 0.0) if enter and not found.any() else found


def text_of(blocks: list[Block], inside: np.ndarray) -> str:
    """The text of the blocks inside, in page order: one line per block, white space runs made one space, blank
    lines between. Text around a child block is in two lines."""
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append(line)

    keep = {id(b) for b, yes in zip(blocks, inside) if yes}
    stack: list = [blocks[0]]
    while stack:
        top = stack.pop()
        if isinstance(top, Block):
            flush()
            stack.append(None)
            own = id(top) in keep
            stack.extend(part for part in reversed(top.parts) if isinstance(part, Block) or own)
        elif top is None:
            flush()
        else:
            held.append(top)
    flush()
    return "\n\n".join(lines)


def marked_blocks(blocks: list[Block]) -> np.ndarray | None:
    """Which blocks the page's own markup says are article; None if it doesn't say."""
    if sum(b.tag in GOOD_TAGS for b in blocks) == 0:
        return None
    label: dict[int, int] = {}
    for b in blocks:
        up = label[id(b.parent)] if b.parent is not None else 0
        bad = b.tag in BAD_TAGS or b.talk or (b.bad and not b.good)
        label[id(b)] = -1 if up == -1 or (bad and up == 1) else 1 if up == 1 or b.tag in GOOD_TAGS else 0
    return np.array([label[id(b)] == 1 for b in blocks])


def _variant(page: list[Block], others: list[str], rng: random.Random) -> tuple[str, str]:
    """The page's article in another layout: (html, main text)."""
    inside = marked_blocks(page)
    lines = text_of(page, inside).split("\n\n")
    layout = rng.choice(["usual"] * 4 + ["breaks", "breaks", "flat", "single", "single"])
    if layout == "single":  # one paragraph and nothing else
        lines = [max(lines, key=len)]
    named = rng.random() < 0.7  # whether attributes tell what a block is

    def words(n: int) -> str:
        source = rng.choice(others).split()
        at = rng.randrange(max(1, len(source) - n))
        return escape(" ".join(source[at : at + n]) or "more")

    def frame(tags: list[str], tokens: set[str], inner: str) -> str:
        tag = rng.choice([*tags, "div", "div", "section"])
        shown = f' {rng.choice(["class", "id"])}="{rng.choice(sorted(tokens))}{rng.choice(["", "-box", " wide"])}"' if named or tag == "div" and rng.random() < 0.5 else ""
        return f"<{tag}{shown}>{inner}</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(n)) + "</ul>"

    def small(n: int = 14) -> str:
        body = words(rng.randint(3, n))
        return rng.choice([body, f"<p>{body}</p>", f'<p>{body} <a href="#">{words(2)}</a></p>'])

    side = [
        lambda: frame(["aside"], {"sidebar", "related", "widget", "side"}, f"<h3>{words(2)}</h3>" + links(rng.randint(2, 7))),
        lambda: frame(["div"], {"ad", "ads", "banner", "sponsored", "advert"}, small()),
        lambda: frame(["div"], {"notice", "cookie", "consent", "alert", "popup"}, small(25)),
        lambda: frame(["form"], {"newsletter", "signup", "search", "subscribe"}, f"<label>{words(3)}</label> {words(5)} <input name=q>"),
        lambda: frame(["nav"], {"menu", "navbar", "breadcrumbs", "nav"}, links(rng.randint(3, 8))),
    ]
    talk = lambda: frame(["section"], {"comments", "comment", "replies", "discussion"}, "".join(
        rng.choice(["<div class=comment><p>{}</p></div>", "<p>{}</p>", "<article class=comment>{}</article>"]).format(words(rng.randint(5, 60))) for _ in range(rng.randint(1, 6))))
    body = []
    if layout == "breaks":  # one block, its lines parted by br
        body.append(rng.choice(["<br>", "<br><br>", "<br/>\n"]).join(map(escape, lines)))
        lines = [" ".join(lines)]
    for i, line in enumerate(lines if layout != "breaks" else []):
        line = escape(line)
        body.append(f"<h1>{line}</h1>" if i == 0 and len(line) < 150 else rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"]).format(line))
        if rng.random() < 0.06:
            body.append(rng.choice(side[:4])())
    if rng.random() < 0.3:
        body.append(talk())
    tag, shown = rng.choice([("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="post-body"'), ("div", ' class="article-body"'), ("div", ""), ("section", ' class="entry"')])
    article = f"<{tag}{shown}>{''.join(body)}</{tag}>"
    if layout == "flat":  # between the other parts, in no block of its own
        article = "".join(body)
    elif rng.random() < 0.4:
        article = f"<div>{article}</div>"
    parts = [frame(["header"], {"header", "masthead", "topbar"}, small(8)), rng.choice(side)(), article, frame(["footer"], {"footer", "copyright", "legal"}, small(25))]
    if rng.random() < 0.7:
        parts.insert(rng.choice([1, 2, 3]), rng.choice(side)())
    if rng.random() < 0.4:
        parts.insert(3, talk())
    return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>", "\n\n".join(lines)


def fit(pages: list[str], variants: int = 4, seed: int = 11) -> boosting.Trees | None:
    """Trees from pages whose markup tells the article; None if there is none."""
    rng = random.Random(seed)
    parsed = [parse(html) for html in pages]
    parsed = [p for p in parsed if marked_blocks(p) is not None]
    if not parsed:
        return None
    others = [text_of(p, marked_blocks(p)) for p in parsed]
    others = [t for t in others if t] or ["more"]
    x, y = [], []
    for page in parsed:
        inside = marked_blocks(page)
        x.append(features(page))
        y.append(inside)
        if not inside.any():
            continue
        for _ in range(variants):
            html, text = _variant(page, others, rng)
            blocks = parse(html)
            x.append(features(blocks))
            y.append(_inside_of(blocks, text))
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(float))


def fitted(pages: DataFrame) -> boosting.Trees:
    """Trees for a table of pages; there always are some."""
    told = sample(pages)
    return fit(told if len(told) >= ENOUGH else told + built_in())


def built_in(n: int = 40, seed: int = 5) -> list[str]:
    """Pages with an article between the usual other parts, of made-up sentences."""
    rng = random.Random(seed)
    syllables = "an be co da el fi ga ho in ka lo mi ne or pu ra se ti un ve".split()

    def sentence(least: int, most: int) -> str:
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
        return " ".join(words).capitalize()

    def page() -> str:
        story = "".join("<p>" + " ".join(sentence(5, 20) + rng.choice(".!?") for _ in range(rng.randint(1, 7))) + "</p>" for _ in range(rng.randint(2, 12)))
        menu = "".join(f'<li><a href="/{i}">{sentence(1, 3)}</a></li>' for i in range(rng.randint(3, 8)))
        return (
            f"<body><header>{sentence(1, 4)}</header><nav><ul>{menu}</ul></nav><article><h1>{sentence(3, 9)}</h1>{story}</article>"
            f"<aside><h3>{sentence(1, 3)}</h3><ul>{menu}</ul></aside><footer>{sentence(3, 12)}.</footer></body>"
        )

    return [page() for _ in range(n)]


def tells(html: str) -> bool:
    """Whether a page's markup tells the article. Mostly the page up to its first such tag shows it; the rest is
    parsed only if that one is in a comment, a script or the like."""
    first = re.search(r"<(?:article|main)(?=[\s/>])[^>]*>?", html, re.I)
    if first is None:
        return False
    return marked_blocks(parse(html[: first.end()])) is not None or marked_blocks(parse(html)) is not None


def _inside_of(blocks: list[Block], text: str) -> np.ndarray:
    """The blocks of a variant that belong to its article: those whose own text is one of its lines, and what holds
    such blocks and mostly them."""
    lines = set(text.split("\n\n"))
    own = [" ".join("".join(p for p in b.parts if isinstance(p, str)).split()) for b in blocks]
    hit = {id(b): len(t) if t in lines else 0 for b, t in zip(blocks, own)}
    for b in reversed(blocks):
        hit[id(b)] += sum(hit[id(c)] for c in b.children)
    top = max(hit[id(b)] for b in blocks)
    inside, region = {}, None
    for b in blocks:  # the deepest block that holds the whole article
        if hit[id(b)] == top and top:
            region = b
    frame = region is not None and region.tag in ("body", "html")  # the article has no block of its own
    for b in blocks:
        up = inside.get(id(b.parent), False) or frame and b.parent is region
        inside[id(b)] = b is region and not frame or (up and hit[id(b)] > 0)
    return np.array([inside[id(b)] for b in blocks])


def sample(pages: DataFrame, max_pages: int = MAX_PAGES) -> list[str]:
    """The bounded sample that `fit` takes, whole pages: of all pages whose markup tells the article, the first by a hash of
    the id, LONG_PAGES of more than MAX_CHARS characters at most."""
    known = pages.where("html IS NOT NULL").select("page_id", F.col("html").cast("string").alias("html"))

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["page_id", "long"]).filter(pa.array([tells(h) for h in batch.column(1).to_pylist()], pa.bool_()))

    marked = known.where(F.col("html").rlike("(?i)<(article|main)[\\s/>]")).withColumn("long", F.length("html") > MAX_CHARS)
    order = F.xxhash64("page_id"), "page_id"
    ids = marked.select("page_id", "html", "long").mapInArrow(telling, f"page_id {known.schema['page_id'].dataType.simpleString()}, long boolean")
    sides = [ids.where("NOT long").orderBy(*order).limit(max_pages), ids.where("long").orderBy(*order).limit(LONG_PAGES)]  # ids first: pages are wide
    chosen = F.broadcast(sides[0].unionByName(sides[1]).select("page_id").distinct())
    rows = known.join(chosen, "page_id", "left_semi").orderBy(F.length("html") > MAX_CHARS, *order, "html").limit(max_pages)
    return [r.html for r in rows.collect() if tells(r.html)]


def main_text(html: str, trees: boosting.Trees) -> str:
    return _texts([html], trees)[0]


def _texts(pages: list[str], trees: boosting.Trees | None) -> list[str]:
    if trees is None:
        return [""] * len(pages)
    parsed = [parse(html) for html in pages]
    odds = trees.log_odds(np.concatenate([features(blocks) for blocks in parsed]))
    stops = np.cumsum([0, *map(len, parsed)])
    return [text_of(blocks, decode(blocks, odds[a:b])) for blocks, a, b in zip(parsed, stops, stops[1:])]


def extract(pages: DataFrame, trees: boosting.Trees | None, block: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from the whole html.

    Null or empty html gives an empty text, and so does a page in which no block is more likely article than not, or
    any page where no sampled page's markup tells an article. Repeated rows have a row each; other columns are left.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                found = _texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
