"""Quality rules: decision lists learned by sequential covering, with DataFrame functions only.

`statistics` counts what rules may look at, `fit` learns an ordered list of threshold conjunctions from labelled
counts, and `DecisionList.verdict` is that list as one Spark conditional expression, first match first.

Learning reads all labelled rows. Every feature has a bounded number of candidate thresholds (quantiles of each
class). A condition is chosen from one grouped count of the rows that the rule still covers (feature, bin): at most
FEATURES x thresholds rows reach the driver, whatever the table's size. Two thirds of the rows grow a rule, condition
by condition, by the information it gains; the other third prunes it to the prefix that separates best there. Rows that
a rule covers leave, and the next rule is learned from the others, until no rule is better than the default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from talus.llm.common import stored, texts
from talus.llm.winnowing import let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS, DIGITS = "#*$%&|<>", ".,;:!?", "0123456789"
WINDOW = 8  # words of a window that may repeat
FEWEST, REPEATED = 20, 30  # words that a kept text has at least, percent of them in repeated windows at most
CUTS = 24  # candidate thresholds of a feature from each class
CONDITIONS, RULES = 4, 12  # most conditions of a rule, most rules of a list
SUPPORT = 5  # rows of its class that a rule covers at least while it grows


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def _count(text: Column, letters: str) -> Column:
    return (F.length(text) - _without(text, letters)).cast("long")


def words(text: Column) -> Column:
    """What ASCII white space separates, in order."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _neighbours(values: Column, step: int, body) -> Column:
    """`body` of every value and the one `step` places on."""
    n = F.size(values) - step
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(values, 1, n), F.slice(values, F.lit(1 + step), n), body))


def _window_hashes(hashes: Column, width: int) -> Column:
    """A hash of every `width` values in a row, from those of half the width."""

    def grow(values: Column, have: int) -> Column:
        if have == width:
            return values
        step = min(have, width - have)
        return let(_neighbours(values, step, lambda a, b: F.xxhash64(a, b)), lambda v: grow(v, have + step))

    return grow(hashes, 1)


def _repeated_words(held: Column, windows: Column, width: int) -> Column:
    """Words in windows that occur twice or more. Equal hashes are neighbours after a sort by (hash, position); the
    words themselves decide."""

    def same(a: Column, b: Column) -> Column:
        equal = (a["h"] == b["h"]) & (F.slice(held, a["i"] + 1, width) == F.slice(held, b["i"] + 1, width))
        return F.when(equal, F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))

    def pairs(order: Column) -> Column:
        n = F.size(order) - 1
        return F.zip_with(F.slice(order, 1, n), F.slice(order, F.lit(2), n), same)

    def covered(at: Column) -> Column:
        n = F.size(at) - 1
        steps = F.zip_with(F.slice(at, 1, n), F.slice(at, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(width)))
        return F.when(n < 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(width), lambda total, x: total + x))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = let(let(ordered, pairs), lambda p: let(F.sort_array(F.array_distinct(F.flatten(p))), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)


def statistics(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and n_lines, n_distinct,
    n_marks, n_digits), one row for each input row, over whole texts.

    A null text has no word. A line counts if it has a word; it is a duplicate if an earlier line is the same string.
    Columns but doc_id and text are not looked at. A text's words are held at once: some hundred bytes each.
    """
    text = F.col("text")

    def of_words(held: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            repeated = let(_window_hashes(hashes, width), lambda w: _repeated_words(held, w, width))
            return F.struct(F.size(held).cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"), F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"))

        return let(F.transform(held, lambda w: F.xxhash64(w)), of_hashes)

    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(SPACE)) != "")
    of_lines = let(lines, lambda held: F.struct(
        F.size(held).cast("long").alias("n_lines"), (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines")))
    made = texts(docs).select(
        "doc_id", let(words(text), of_words).alias("w"), of_lines.alias("l"), _without(text, SPACE).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"), _count(text, MARKS).alias("n_marks"), _count(text, DIGITS).alias("n_digits"))
    failed = (F.col("w.n_words") < FEWEST) | (100 * F.col("w.n_repeat_words") > REPEATED * F.col("w.n_words"))
    return made.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"),
        "l.n_lines", "w.n_distinct", "n_marks", "n_digits")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """What a condition may look at, from the columns of `statistics`; none is ever null."""
    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": _share("word_chars", "n_words"), "symbols_per_word": _share("n_symbols", "n_words"),
        "duplicate_lines": _share("n_dup_lines", "n_lines"), "repeated_words": _share("n_repeat_words", "n_words"),
        "distinct_words": _share("n_distinct", "n_words"), "marks_per_word": _share("n_marks", "n_words"),
        "digits_per_char": _share("n_digits", "word_chars"), "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.threshold if self.above else of[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction for `target`; where none holds, the other class."""

    target: int
    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, of: dict[str, Column]) -> Column:
        """1 for good, 0 for bad: the class of the first rule that holds."""
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(_all(rule, of), F.lit(self.target))
        return F.lit(1 - self.target) if out is None else out.otherwise(F.lit(1 - self.target))

    def __str__(self) -> str:
        return "\n".join([*(f"{' and '.join(map(str, rule))}: {self.target}" for rule in self.rules), f"else: {1 - self.target}"])


def _all(rule: list[Condition], of: dict[str, Column]) -> Column:
    held = F.lit(True)
    for condition in rule:
        held = held & condition.column(of)
    return held


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the features, good 0/1) of the labelled rows that do not fail the base rules. An id labelled more than once
    counts with its worse label; labels that are neither 0 nor 1 do not count, nor do ids that only one side has."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    marks = marks.where(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = stats.where("NOT base_failed").select("doc_id", *[c.alias(name) for name, c in features().items()])
    return rows.join(marks, "doc_id")


def fit(rows: DataFrame, cuts: int = CUTS, conditions: int = CONDITIONS, rules: int = RULES, support: int = SUPPORT) -> DecisionList:
    """The decision list of labelled rows (doc_id, good, and a double column for every feature). Its rules describe
    the rarer class. Without a row of that class the list has no rule."""
    names = [c for c in rows.columns if c not in ("doc_id", "good")]
    rows = stored(rows.withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0), "quality-labelled")
    sizes = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = 1 if sizes.get(1, 0) < sizes.get(0, 0) else 0
    learned = DecisionList(target)
    if not sizes.get(target):
        return learned
    grid = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = rows.groupBy("good").agg(*[F.percentile_approx(n, grid, 10000).alias(n) for n in names]).collect()
    edges = {n: sorted({float(x) for r in found for x in r[n]}) for n in names}
    own = {n: F.col(n) for n in names}
    hit = F.col("good") == target
    left = rows  # not covered by a rule so far
    while len(learned.rules) < rules:
        rule = _pruned(left.where("NOT grow"), _grown(left.where("grow"), edges, hit, conditions, support), own, hit)
        if not rule:
            break
        learned.rules.append(rule)
        left = left.where(~_all(rule, own))
    return learned


def _grown(rows: DataFrame, edges: dict[str, list[float]], hit: Column, conditions: int, support: int) -> list[Condition]:
    """A conjunction, condition by condition: the one that gains most information over what the rule covers."""
    rule: list[Condition] = []
    own = {n: F.col(n) for n in edges}
    while len(rule) < conditions:
        covered = rows.where(_all(rule, own)) if rule else rows
        # the bin of a value: how many thresholds it reaches
        bins = [F.struct(F.lit(n).alias("name"), sum((F.col(n) >= e).cast("int") for e in held).alias("bin")) for n, held in edges.items()]
        counts = covered.select(hit.cast("long").alias("hit"), F.explode(F.array(*bins)).alias("b")).groupBy("b.name", "b.bin")
        counts = counts.agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).collect()
        best = (1e-9, None, 0)
        for name, held in edges.items():
            own_bins = {r["bin"]: (r["hits"], r["n"]) for r in counts if r["name"] == name}
            hits, total = (sum(v[k] for v in own_bins.values()) for k in (0, 1))
            if not hits or hits == total:
                continue  # nothing to tell apart
            below_hits = below = 0
            for at, edge in enumerate(held):
                below_hits, below = below_hits + own_bins.get(at, (0, 0))[0], below + own_bins.get(at, (0, 0))[1]
                for above, p, n in ((True, hits - below_hits, total - below), (False, below_hits, below)):
                    if p >= min(support, hits) and n < total:
                        gain = p * (math.log2(p / n) - math.log2(hits / total))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, edge), n - p)
        if best[1] is None:
            break
        rule.append(best[1])
        if not best[2]:
            break
    return rule


def _pruned(rows: DataFrame, rule: list[Condition], own: dict[str, Column], hit: Column) -> list[Condition]:
    """The prefix of a rule that separates best on rows it was not grown from; none if that is no better than chance."""
    if not rule:
        return []
    counts = []
    for k in range(1, len(rule) + 1):
        held = _all(rule[:k], own)
        counts += [F.count_if(held & hit).alias(f"p{k}"), F.count_if(held).alias(f"n{k}")]
    row = rows.agg(*counts).first()
    precision = [(row[f"p{k}"] + 1) / (row[f"n{k}"] + 2) for k in range(1, len(rule) + 1)]
    best = precision.index(max(precision))  # the shortest of equals
    return rule[: best + 1] if precision[best] > 0.5 else []


def verdicts(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of `statistics` with `kept`: false where the base rules fail, else what the list says."""
    return stats.withColumn("kept", ~F.col("base_failed") & (rules.verdict(features()) == 1))
