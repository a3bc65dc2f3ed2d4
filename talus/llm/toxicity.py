"""Toxicity by compression distance: a zstandard dictionary for toxic text and one for ordinary text.

A window of a text is compressed with each dictionary. What the toxic dictionary saves against the ordinary one,
in bytes, is the window's score; a document has, for calibrated thresholds, the odds of as many hits among its windows as it
has, and a logistic curve calibrated on labelled rows turns these into a score from 0 to 1.

Both dictionaries are trained by zstandard. The ordinary one learns from windows of ordinary texts, the toxic one besides
from windows of toxic texts weighted by what tells them apart: the log odds of short strings, from how often windows of
either class hold them. A string counts that ordinary texts hold as well, if rarer, so density tells, not only presence.

Fitting takes a bounded sample of labelled rows (`max_rows` per class, in the order of a hash of the id) and of windows
(`MAX_WINDOWS` of a text, from all over it); the scoring covers every window of every text. The curve is calibrated on
each half of the sample with dictionaries of the other half; the final dictionaries are those of the whole sample.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from talus.llm.common import forget, texts

MAX_ROWS = 2000  # labelled rows of each class that are fetched for fitting
MAX_WINDOWS = 80  # windows of one labelled text, in fitting only
WINDOW, STEP = 60, 40  # bytes; so short that zstandard leaves literals as they are, and a byte saved is a match
GRAM = 5  # bytes of the strings that are weighed
BEHIND = 3  # bytes of the word behind a telling string that are learnt with it: longer matches stand out more
SEEN = 24  # windows of an ordinary text that the ordinary dictionary learns from, half of them at first
BUCKETS = 1 << 21  # to which strings are hashed while they are counted
TOLD = 5.0  # how much more often windows of toxic texts hold a telling string
SURE = 6.0  # standard deviations by which they do
DICTIONARY, TOXIC_DICTIONARY = 96 << 10, 12 << 10  # bytes
LEVELS = (0.01, 0.003, 0.0003)  # shares of ordinary windows that reach a threshold
LIKELY = 25.0  # log odds beyond which more hits, or more windows without one, say nothing new
TRAINED = {"k": 32, "d": 6, "f": 20, "accel": 1, "split_point": 1.0}  # zstandard's trainer: segments of 32 bytes, by strings of 6
BALANCE = 0.3  # weight of the toxic rows of the sample in the calibration, against 1 - BALANCE of the ordinary ones
_STARTS = re.compile(rb" (?=.{23})", re.S)
_OTHER = re.compile(rb"[^a-z\x80-\xff]+")

Sample = tuple[list[bytes], int]  # windows of a text, and how many it has


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows over the whole text, ASCII letters in lower case."""
    text = text.lower()
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)] if text else []


def some_windows(text: bytes, most: int = MAX_WINDOWS) -> Sample:
    """At most so many windows of a text, drawn from all over it by its own checksum, in their order."""
    held = windows(text)
    if len(held) <= most:
        return held, len(held)
    return [held[i] for i in sorted(random.Random(zlib.crc32(text)).sample(range(len(held)), most))], len(held)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    rules = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, window_log=18, hash_log=18, chain_log=18, search_log=4, min_match=6,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=held, compression_params=rules)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    levels: list[tuple[int, float, float]]
    weights: list[float]

    def scorer(self):
        """bytes -> score; make it once per task."""
        if not self.toxic:
            return lambda text: self.weights[0]
        one, two = _compressor(self.toxic), _compressor(self.ordinary)
        weights = np.array(self.weights)

        def score(text: bytes) -> float:
            x = weights[0] + weights[1:] @ _features(_gains(windows(text), one, two), self.levels)
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return score


def _gains(held: list[bytes], one, two) -> list[int]:
    a, b = one.compress, two.compress
    return [len(b(w)) - len(a(w)) for w in held] or [0]


def _features(gains: list[int], levels: list[tuple[int, float, float]], scale: float = 1.0) -> np.ndarray:
    """What the curve sees of a text's gains: for every level (threshold, hits a window of toxic and of ordinary texts) how
    much likelier the number of hits is at the toxic rate. `scale` is how many windows each gain stands for."""
    held = np.array(gains)
    told = [(held >= t).sum() * np.log(p / q) - len(held) * (p - q) for t, p, q in levels]
    return np.clip(np.array(told) * scale, -LIKELY, LIKELY)


def _levels(toxic: list[list[int]], ordinary: list[list[int]]) -> list[tuple[int, float, float]]:
    """Thresholds that few ordinary windows reach, and how often windows of either class do."""
    a, b = (np.concatenate([np.array(g) for g in held]) for held in (toxic, ordinary))
    out = []
    for share in LEVELS:
        threshold = int(np.quantile(b, 1 - share)) + 1
        q = max(float((b >= threshold).mean()), 1e-5)
        out.append((threshold, max(float((a >= threshold).mean()), 2 * q), q))
    return out


def _train(samples: list[bytes], size: int, **options) -> bytes:
    """The content zstandard's trainer picks from samples (its entropy tables are left off); the newest samples
    themselves where there are too few to train on."""
    try:
        whole = zstandard.train_dictionary(size, samples, **options)
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    data = whole.as_bytes()
    # the content is the tail of the file, after tables of a few hundred bytes
    return data[min(len(data), 512) :]


def _distinct(held: list[Sample]) -> list[Sample]:
    """Texts without those of which more than a third was seen before: copies would make any word look telling."""
    seen: set[bytes] = set()
    kept = []
    for sample in held:
        own = {x for text in sample[0] for m in _STARTS.finditer(text) if zlib.crc32(x := text[m.start() : m.start() + 24]) % 4 == 0}
        if not own or len(own & seen) * 3 <= len(own):
            kept.append(sample)
        seen |= own
    return kept


def _buckets(held: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Windows with everything but letters as one space, and the bucket of the string at every place of each: strings
    inside a word or at its start, with the space before it. Other places have bucket 0."""
    plain = [_OTHER.sub(b" ", b" " + w) for w in held]
    width = max(map(len, plain), default=0) + GRAM
    data = np.frombuffer(b"".join(w.ljust(width, b" ") for w in plain), np.uint8).reshape(len(plain), width)
    places = width - GRAM + 1
    codes, inside = np.zeros((len(plain), places), np.uint64), np.ones((len(plain), places), bool)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            own = data[:, i : i + places]
            codes = codes * np.uint64(0x100000001B3) + own + np.uint64(1)
            if i:
                inside &= own != 32
        codes = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    return plain, np.where(inside, codes, 0).astype(np.int64)


def _log_odds(toxic: list[Sample], ordinary: list[Sample]) -> np.ndarray:
    """For every bucket the log odds of its strings in windows of toxic texts against those of ordinary ones. It is 0 unless
    windows hold them TOLD times as often, and texts more often by SURE standard deviations: a text that repeats a
    string does not make it tell."""
    rates, shares = [], []
    for held in (toxic, ordinary):
        counts, texts_with, n = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0
        for sample, _ in held:
            if sample:
                kinds, often = np.unique(_buckets(sample)[1], return_counts=True)
                counts[kinds] += often
                texts_with[kinds] += 1
                n += len(sample)
        rates.append((counts + 0.1) / max(n, 1))
        shares.append(texts_with / max(len(held), 1))
    (p, q), (a, b), sizes = rates, shares, (len(toxic), len(ordinary))
    odds = np.zeros(BUCKETS, np.float32)
    told = np.flatnonzero((p > TOLD * q) & (a > b))
    told = told[told > 0]
    p, q, a, b = p[told], q[told], a[told], b[told]
    mean = (a * sizes[0] + b * sizes[1]) / sum(sizes)
    sigma = np.sqrt(mean * (1 - mean) * (1 / sizes[0] + 1 / sizes[1])) + 1e-9
    odds[told] = np.where((a - b) / sigma > SURE, np.log(p / q), 0.0)
    return odds


def _excerpts(sample: Sample, odds: np.ndarray) -> bytes:
    """What of a text's windows tells: from the start of the word to a little behind the last telling string, each stretch
    as often as its log odds."""
    if not sample[0]:
        return b""
    plain, codes = _buckets(sample[0])
    weights = odds[codes]
    out = []
    for row in np.flatnonzero(weights.any(axis=1)).tolist():
        text, own = plain[row], weights[row]
        at = np.flatnonzero(own)
        for run in np.split(at, np.flatnonzero(np.diff(at) > GRAM) + 1):
            start, stop = int(run[0]), int(run[-1]) + GRAM
            while start > 0 and text[start] != 32:  # with the space before the first word
                start -= 1
            while stop < min(len(text), int(run[-1]) + GRAM + BEHIND) and text[stop] != 32:
                stop += 1
            out += [text[start:stop]] * int(np.ceil(own[run].max()))
    return b"".join(out)


def fit(rows: list[tuple[bytes, int]] | list[tuple[Sample, int]], seed: int = 7) -> Model:
    """Rows of (text, toxic), or of (windows of a text and their number, toxic). With fewer than 8 rows of a class the score
    is the smoothed share of toxic rows."""
    rows = [(some_windows(text) if isinstance(text, bytes) else text, label) for text, label in rows]
    toxic, ordinary = (_distinct([t for t, y in rows if bool(y) == kind]) for kind in (True, False))
    if min(len(toxic), len(ordinary)) < 8:
        return Model(b"", b"", [], [(len(toxic) + 0.1) / (len(rows) + 1)])
    # each half is scored with the dictionaries of the other, as a text's own dictionary remembers it
    halves = [(x[::2], x[1::2]) for x in (toxic, ordinary)]
    gains, scales, labels = [], [], []
    for own, other in ((0, 1), (1, 0)):
        one, two = map(_compressor, _dictionaries(halves[0][own], halves[1][own], seed))
        for label, samples in ((1, halves[0][other]), (0, halves[1][other])):
            gains += [_gains(held, one, two) for held, _ in samples]
            scales += [n / max(len(held), 1) for held, n in samples]
            labels += [label] * len(samples)
    levels = _levels(*[[g for g, y in zip(gains, labels) if y == kind] for kind in (1, 0)])
    weights = _logistic(np.array([_features(g, levels, x) for g, x in zip(gains, scales)]), np.array(labels, dtype=float))
    return Model(*_dictionaries(toxic, ordinary, seed), levels, list(weights))


def _plain_windows(held: list[bytes], odds: np.ndarray) -> list[bytes]:
    """The windows that hold nothing that tells."""
    if not held:
        return []
    keep = ~odds[_buckets(held)[1]].any(axis=1)
    return [w for w, k in zip(held, keep.tolist()) if k]


def _dictionaries(toxic: list[Sample], ordinary: list[Sample], seed: int) -> tuple[bytes, bytes]:
    """(toxic, ordinary). Both know ordinary text without what tells; the toxic one ends in what is trained on telling
    excerpts, nearest to the window: the rest of a toxic window is ordinary text. Where nothing tells, it is trained on
    the toxic windows. Windows that hold nothing that tells and yet gain are learnt as ordinary in a second pass."""
    rng = random.Random(seed)
    odds = _log_odds(toxic, ordinary)
    plain = [_plain_windows(rng.sample(held, min(len(held), SEEN)), odds) for held, _ in ordinary]
    base = _train([w for held in plain for w in held[: SEEN // 2]], DICTIONARY)
    excerpts = [x for sample in toxic if len(x := _excerpts(sample, odds)) >= 16]
    if not excerpts:
        excerpts = [w for held, _ in toxic for w in held]
    own = _train(excerpts, TOXIC_DICTIONARY, **TRAINED)
    one, two = _compressor(base + own), _compressor(base)
    alike = [w for held in plain for w, gain in zip(held, _gains(held, one, two)) if gain >= 2]
    base += _train(alike, TOXIC_DICTIONARY, **TRAINED) if alike else b""
    return base + own, base


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.001, balance: float = BALANCE) -> np.ndarray:
    """Intercept and weights; the ridge looks at features of one scale."""
    middle, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-3, spread, 1e9)  # what hardly varies tells nothing
    x = np.hstack([np.ones((len(x), 1)), (x - middle) / spread])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1)) * len(y)
    share = np.where(y > 0, balance / max(y.mean(), 1e-9), (1 - balance) / max(1 - y.mean(), 1e-9))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + keep @ w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep
        w = w - np.linalg.solve(curve, gradient)
    own = w[1:] / spread
    return np.concatenate([[w[0] - own @ middle], own])


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = MAX_ROWS, max_windows: int = MAX_WINDOWS) -> list[tuple[Sample, int]]:
    """Windows (`max_windows` at most) of at most `max_rows` labelled texts of each class among the ids that `allowed` lets
    through, in the order of a hash of the id. Ids are chosen on the narrow label table, so only their texts are read, and
    only windows leave the tasks."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sides = [chosen.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for kind in (0, 1)]
    picked = F.broadcast(sides[0].unionByName(sides[1]))  # 2 * max_rows ids at most

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [some_windows(text.as_buffer().to_pybytes(), max_windows) for text in batch.column(1).cast(pa.binary())]
            held, n = pa.array([w for w, _ in drawn], pa.list_(pa.binary())), pa.array([n for _, n in drawn], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), held, n, batch.column(2)], names=["doc_id", "windows", "n", "toxic"])

    rows = texts(docs).join(picked, "doc_id").select("doc_id", "text", "toxic").mapInArrow(draw, "doc_id long, windows array<binary>, n long, toxic int")
    return [(([bytes(w) for w in r.windows], r.n), r.toxic) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.windows))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row and every window of its whole text. A null text is empty; an empty text has the
    score of a text without any saving. Repeated rows get a row each; no input column but the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(text.as_buffer().to_pybytes()) for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores below `threshold`. Only the text leaves the JVM."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        of = model.scorer()
        for held in batches:
            yield pa.array([of(text.as_buffer().to_pybytes()) < threshold for text in held.cast(pa.binary())], pa.bool_())

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
