"""Chat formatting by event-sourced reconstruction (DataFrame operations only).

A conversation is a log of events, ordered by a sequence number:

* ``message``     starts the next message of the conversation;
* ``delta``       adds text to a message (a streamed piece);
* ``edit``        replaces the text of a message; later deltas add to it;
* ``regenerate``  drops a message's text and starts it anew.

``target`` names the message (0, 1, ...) that a delta, edit or regeneration
is about; null means the latest one.  The log is partitioned by conversation
once; the fold is a running count of message starts, a running count of
restarts inside a message, and the concatenation of the last version's
pieces, all in that one partitioning.  Final messages are then rendered.

The template marks each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside texts and roles are broken by a backslash after their
first character, and a backslash is doubled, so no text can open or close a
turn and :func:`unescape` gives the exact text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's own marks and those of other common templates.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"
CONTROL_STRINGS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL_STRINGS:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def fold_events(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq") -> DataFrame:
    """Final messages: ``conv``, ``slot`` (0, 1, ...), ``role``, ``text``.

    ``events`` has ``kind``, ``role``, ``text`` and ``target`` besides the two
    named columns; others are ignored.  Null text is empty, null role is
    empty, an unknown or null kind counts as ``message``.  Events with the
    same (or null, which comes first) sequence number are taken in the order
    of kind (messages first, then by name), role, text, target; equal events
    each count.  A first event that is not
    a message starts one.  The role of a message is that of its first event.
    An event whose target has not started is about the latest message.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")) \
        .otherwise(F.lit("message"))
    rows = events.select(
        F.col(conv_col).alias("conv"), F.col(seq_col).alias("seq"), kind.alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("target").cast("long").alias("target"))
    order = [F.col("seq").asc_nulls_first(), "kind_order", "kind", "role", "text", "target"]
    rows = rows.withColumn("kind_order", F.when(F.col("kind") == "message", 0).otherwise(1))
    by_conv = Window.partitionBy("conv").orderBy(*order)
    numbered = rows.withColumn("n", F.row_number().over(by_conv))
    starts = (F.col("kind") == "message") | (F.col("n") == 1)
    running = Window.partitionBy("conv").orderBy("n") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = numbered.withColumn("latest", F.sum(starts.cast("long")).over(running) - 1)
    about = F.when(~starts & F.col("target").between(0, F.col("latest")), F.col("target")) \
        .otherwise(F.col("latest"))
    placed = placed.withColumn("slot", about)
    restart = F.col("kind") != "delta"
    in_slot = Window.partitionBy("conv", "slot").orderBy("n") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    versions = placed.withColumn("version", F.sum(restart.cast("long")).over(in_slot))
    whole_slot = Window.partitionBy("conv", "slot")
    last = versions.withColumn("last_version", F.max("version").over(whole_slot)) \
        .withColumn("slot_role", F.min(F.struct("n", "role")).over(whole_slot)["role"]) \
        .filter(F.col("version") == F.col("last_version"))
    pieces = F.sort_array(F.collect_list(F.struct("n", "text")))
    return last.groupBy("conv", "slot").agg(
        F.first("slot_role").alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_spans``,
    the code point ranges [start, end) of the texts that are trained on."""
    turns = F.sort_array(F.collect_list(F.struct(
        "slot", "role", escape_role(F.col("role")).alias("head"),
        escape(F.col("text")).alias("body"))))
    listed = messages.groupBy("conv").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(
        F.lit(TURN_START), t["head"], F.lit("\n"), t["body"], F.lit(TURN_END + "\n"))), "")
    ahead = len(TURN_START) + 1
    behind = len(TURN_END) + 1
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"),
                 F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + (ahead + behind)).alias("at"),
            F.when(t["role"].isin(*loss_roles), F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["head"]) + ahead).alias("start"),
                (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + ahead).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))["spans"]
    return listed.select("conv", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_spans`` alone: ``conv``, ``turns`` (array
    of role and text) and ``loss_text`` (all text under the mask)."""
    start, end = (m.replace("|", "\\|") for m in (TURN_START, TURN_END))
    chunks = F.slice(F.split(F.col("formatted"), start, -1), F.lit(2),
                     F.size(F.split(F.col("formatted"), start, -1)))
    head = r"^((?:[^\\\n]|\\[\s\S])*)\n"
    turns = F.transform(chunks, lambda c: F.struct(
        unescape(F.regexp_extract(c, head, 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(c, head, ""), f"{end}\\n$", "")).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"),
        (s["end"] - s["start"]).cast("int")))), "")
    return rendered.select("conv", "formatted", turns.alias("turns"), loss.alias("loss_text"))
