"""Exact dedup by distributed MSD radix partitioning.

The digits of a text are successive stretches of it, each four times as long as the one before, so any length
takes a logarithmic number of rounds. A round splits every open group by the next digit. Groups of one text are
done, and so are groups whose texts end inside the digit: equal digits down to the end are equal texts, no digest
involved. Only the rows of groups that are still open go on to the next round.

A group is named by its first row, found by a grouped minimum that combines in the tasks before the shuffle; rows
learn it back through a join that adaptive execution can split, so a group that holds a third of all rows is many
tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talus.llm.common import fresh, stored, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_DIGIT, GROWTH = 256, 4  # code points of the first digit, growth of each later one


def _named(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("tag", F.xxhash64("text"))


def _same(left: list[str], right: list[str]):
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def equal_groups(docs: DataFrame, fold_case: bool = True) -> DataFrame:
    """(doc_id, tag, keep_id, group_size): the group of every row with texts equal after lower-casing A-Z.

    `tag` is a 64-bit hash of the text that, with the id, names a row, so rows that repeat an id with other texts
    stay apart; it never decides equality, the digits do. Rows that repeat both id and text all count in
    `group_size` and share one result row. A null text is empty, empty texts are equal to each other, a null id is
    smaller than any other (`keep_id` is null only where all ids of the group are).
    """
    rows, open_rows, done, start, width = _named(docs), None, [], 0, FIRST_DIGIT
    while True:
        digits = rows.select(
            "doc_id", "tag", F.substring("text", start + 1, width).alias("digit"), (F.length("text") <= start + width).alias("ends"),
        )
        if open_rows is None:
            members = digits.withColumns({"grp_id": F.lit(None).cast("long"), "grp_tag": F.lit(0).cast("long")})
        else:
            digits = digits.where(F.length("digit") > 0)
            members = digits.join(open_rows, _same(["doc_id", "tag"], ["o_id", "o_tag"])).drop("o_id", "o_tag")
        if fold_case:
            members = members.withColumn("digit", F.translate("digit", UPPER, LOWER))
        members = stored(members, "radix-digits")
        keys = ["grp_id", "grp_tag", "digit", "ends"]
        groups = members.groupBy(*keys).agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(F.struct("doc_id", "tag")).alias("first")
        )
        groups = groups.withColumnsRenamed({k: f"g_{k}" for k in keys})
        split = members.join(groups, _same(keys, [f"g_{k}" for k in keys]))
        split = stored(split.select("doc_id", "tag", "ends", "keep_id", "group_size", "first"), "radix-groups")
        over = F.col("ends") | (F.col("group_size") == 1)
        done.append(split.where(over).select("doc_id", "tag", "keep_id", "group_size"))
        still = split.where(~over)
        if still.isEmpty():
            break
        open_rows = still.select(
            F.col("doc_id").alias("o_id"), F.col("tag").alias("o_tag"),
            F.col("first.doc_id").alias("grp_id"), F.col("first.tag").alias("grp_tag"),
        ).distinct()
        start, width = start + width, width * GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["doc_id", "tag"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    The row with the largest id of its group is kept. Rows that repeat an id and a text are marked alike.
    """

    def digests(batches):
        for batch in batches:
            lower = [hashlib.sha256(t.as_buffer().to_pybytes().lower()).hexdigest() for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lower, pa.string())], names=["doc_id", "tag", "text_sha256"])

    groups = equal_groups(docs).withColumnsRenamed({"doc_id": "g_id", "tag": "g_tag"})
    rows = _named(docs).select("doc_id", "tag", "text").mapInArrow(digests, "doc_id long, tag long, text_sha256 string")
    joined = rows.join(groups, _same(["doc_id", "tag"], ["g_id", "g_tag"]))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The kept rows of `docs`, with all their columns; repeated rows of a kept id with equal texts leave one."""
    groups = equal_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # ids that occur once in their group are the rule; only the others need a look at whole rows
    own_id, own_tag, size, row, text = fresh(docs, "kept_id", "kept_tag", "kept_size", "kept_row", "kept_text")
    chosen = groups.select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag), F.col("group_size").alias(size))
    row_tag = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (row_tag == F.col(own_tag)))
    many = F.col(size) > 1
    repeated = kept.where(many).groupBy(own_id, F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias(text))
    repeated = repeated.agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return kept.where(~many).select(*docs.columns).unionByName(repeated)
