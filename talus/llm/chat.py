"""Chat formatting from an event log, with DataFrame functions only.

A log row says what happened to a turn of a conversation:

  message     the turn has this text                        delta     this text is added to the turn's end
  edit        the turn's text becomes this one              regenerate  the turn starts anew with this text; later
                                                                        turns of the conversation are void

Rows are folded in `seq` order. Per (conversation, turn) the last row that sets the text and the deltas after it
count; a regeneration voids what earlier rows said about later turns. The fold per turn is grouped first, so that
a conversation's own group holds one row per turn.

The template marks turns as

  <|turn|>role<|text|>text<|end|>

and conversations are the concatenation of their turns. Inside roles and texts every backslash, `<` and `[` gets a
backslash behind it, so no control string of this or a similar template can occur there, and taking these backslashes
away, from left to right, gives the text back. The loss mask covers the text of assistant turns, as spans of code points of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = "assistant"
SETS = ["message", "edit", "regenerate"]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def events(messages: DataFrame) -> DataFrame:
    """A log with one `message` row for each row of a (conv_id, turn, role, text) table, in turn order."""
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"),
        F.lit("message").alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def final_messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, nr, role, text): the messages that stand after all events.

    `log` has conv_id, seq, turn, kind, role, text. Null texts and roles are empty; a null kind is a message; unknown
    kinds change nothing. `message` rows never replace each other: where a turn number repeats, each message is a
    message of its own (`nr` counts them, in the order of seq, role, text), and deltas and edits go to the last one
    before them. Rows with the same seq are taken in the order of kind, role and text. A delta or edit without an
    earlier message starts one.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    rows = log.select(
        "conv_id", "turn", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where(F.col("kind").isin("delta", *SETS))
    # a regeneration of turn t at s voids whatever was said before s about turns after t; its own turn is reset
    cuts = rows.where(F.col("kind") == "regenerate").groupBy("conv_id", F.col("turn").alias("cut")).agg(F.max("seq").alias("at"))
    cuts = cuts.groupBy("conv_id").agg(F.collect_list(F.struct("cut", "at")).alias("cuts"))
    kept = rows.join(cuts, "conv_id", "left")
    void = F.exists("cuts", lambda c: (F.col("turn") > c["cut"]) & (F.col("seq") < c["at"]) | (F.col("turn") == c["cut"]) & (F.col("seq") < c["at"]))
    kept = kept.where(~F.coalesce(void, F.lit(False))).drop("cuts")
    order = ["seq", "kind", "role", "text"]
    inside = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("kind").isin("message", "regenerate")
    numbered = kept.withColumn("nr", F.greatest(F.sum(starts.cast("int")).over(inside), F.lit(1)))
    folded = numbered.groupBy("conv_id", "turn", "nr").agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("said"), F.min_by("role", F.struct(*order)).alias("role")
    )
    text = F.aggregate("said", F.lit(""), lambda done, e: F.when(e["kind"] == "delta", F.concat(done, e["text"])).otherwise(e["text"]))
    return folded.select("conv_id", "turn", "nr", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation, from (conv_id, turn, nr, role, text). `loss` holds the
    spans under the mask as structs of start and length, in code points of `formatted`.

    A conversation without a row has no output. The grouped rows of a conversation are its output's size, the one
    thing that has to meet in a row here.
    """
    marked = messages.select(
        "conv_id", F.struct("turn", "nr").alias("place"), (F.col("role") == LEARNED).alias("learned"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"),
    )
    grouped = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "learned"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # running place of each turn, then its spans
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start, size = state["at"] + F.length(t["head"]), F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + F.lit(len(END))).alias("at"),
            F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return grouped.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", begin, step)["spans"].alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, turns): `turns` holds role and text of every turn, read from the output alone."""
    pieces = F.filter(F.split("formatted", r"\Q" + TURN + r"\E", -1), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END)))
    turns = F.transform(
        bare,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, TEXT, 1)) + len(TEXT) + 1, F.length(p))).alias("text"),
        ),
    )
    return rendered.select("conv_id", "formatted", "loss", turns.alias("turns"))


def report(messages: DataFrame) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A null conv_id is a conversation of its own."""
    back = parse(render(final_messages(events(messages))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = unescape_spans(F.col("formatted"), F.col("loss"))
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learned.alias("learned"), "formatted")
    return back.select(
        "conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def unescape_spans(formatted: Column, loss: Column) -> Column:
    """The text under the mask: its spans cut out of the output, without their escapes, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
