"""Document fingerprints by winnowing, with DataFrame functions only.

A text in lower case is a sequence of units: runs of characters that are not ASCII white space, cut after 16
characters. Every `k` units in a row have a hash; of every `window` hashes in a row the smallest is chosen, the
rightmost where several are equal, and stays with its position. Two texts that share `k + window - 1` units in a row
therefore share a chosen hash. Texts too short for a window keep all their hashes. A choice is one minimum over longs: the upper bits hold the hash, the lower 31 bits
the position counted down, and the minima of 1, 2, 4 ... hashes are built on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talus.llm.common import texts

K, WINDOW = 4, 4
UNIT = r"([^\x20\x09-\x0D]{1,16})"
LOW = (1 << 31) - 1  # bits of a position
BUCKET = 512  # neighbouring ids that are ordered together


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _units(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(1)), lambda unit: F.xxhash64(unit))


def _hashes(units: Column, k: int) -> Column:
    """Hash of every k units in a row; of every unit where there are fewer."""
    n = F.size(units)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, units).otherwise(rows)


def _minima(packed: Column, window: int) -> Column:
    """The minimum of every `window` values in a row; all values where there are fewer."""

    def grow(values: Column, width: int) -> Column:
        if width == window:
            return values
        step = min(width, window - width)
        return let(values, lambda v: grow(_pairs(v, step), width + step))

    return F.when(F.size(packed) < window, packed).otherwise(grow(packed, 1))


def _pairs(values: Column, step: int) -> Column:
    n = F.size(values) - step
    return F.zip_with(F.slice(values, 1, n), F.slice(values, F.lit(1 + step), n), lambda a, b: F.least(a, b))


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<hash long, position int>>: the chosen hashes of a text, in page order; no unit, no hash."""
    return let(
        let(_units(text), lambda u: _hashes(u, k)),
        lambda h: F.transform(
            F.array_distinct(let(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.lit(LOW) - i)), lambda p: _minima(p, window))),
            lambda v: let(
                (F.lit(LOW) - v.bitwiseAND(F.lit(LOW))).cast("int"), lambda at: F.struct(F.get(h, at).alias("hash"), at.alias("position"))
            ),
        ),
    )


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The set of chosen hashes as array<int>; a null text is empty and has none."""
    return F.array_distinct(F.transform(chosen(F.coalesce(text, F.lit("")), k, window), lambda c: F.hash(c["hash"])))


def digest(prints: Column) -> Column:
    """One string for a fingerprint, the same for equal sets."""
    return F.md5(F.array_join(F.array_sort(prints).cast("array<string>"), ",").cast("binary"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of two fingerprints; 1 where both have none."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / F.greatest(F.size(a) + F.size(b) - n, F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def with_next(docs: DataFrame, derived: dict[str, Column], bucket: int = BUCKET) -> DataFrame:
    """Every row of (doc_id, text) with the columns of `derived`, which are made from `text`, and with next_text and
    next_<name>: those of the row that follows in ascending doc_id, the first after the last.

    Whole rows move once, to their bucket of neighbouring ids. The last row of a bucket needs the first text of the
    next bucket; these few texts join where the rows already are. Null ids come first;
    rows of one id follow each other in the order of their texts.
    """
    first_of_all = -(1 << 62)  # the bucket of null ids
    placed = docs.select("doc_id", "text", F.coalesce(F.floor(F.col("doc_id") / F.lit(bucket)).cast("long"), F.lit(first_of_all)).alias("_b"))
    order = Window.partitionBy("_b").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    # only texts move: `derived` is made between two windows over the same order, after the exchange
    rows = placed.withColumn("next_text", F.lead("text").over(order)).withColumns(derived)
    rows = rows.withColumns({f"next_{name}": F.lead(name).over(order) for name in derived})

    line = Window.orderBy("_b")  # over one narrow row per bucket
    follows = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    follows = follows.select(F.col("_b").alias("_from"), F.coalesce(F.lead("_b").over(line), F.min("_b").over(Window.partitionBy())).alias("_to"))
    # tasks keep one row per bucket before anything moves
    heads = placed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).select("_b", "text")
    heads = heads.withColumns(derived).join(follows, F.col("_b") == F.col("_to"))
    heads = heads.select(F.col("_from").alias("_hb"), *[F.col(name).alias(f"_head_{name}") for name in ("text", *derived)])
    out = rows.join(heads, F.col("_b") == F.col("_hb"), "left")
    return out.select(
        "doc_id", "text", *derived, *[F.coalesce(f"next_{name}", f"_head_{name}").alias(f"next_{name}") for name in ("text", *derived)]
    )


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (the later half replaced by the start of the next
    document), and how alike they are: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty; repeated rows have a row each."""
    # a document's fingerprint is made once, for itself and for its predecessor
    pairs = with_next(texts(docs), {"prints": fingerprint(F.col("text"))})
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, cast(length(text) div 2 as int))"))
    made = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.col("prints").alias("a"), F.col("next_prints").alias("c"), edited.alias("edited"),
    )
    made = made.select("doc_id", "n_chars", "a", "c", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("b"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("a")).alias("fingerprint"), digest(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
