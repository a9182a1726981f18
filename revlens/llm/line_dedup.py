"""Line dedup by winnowing over line hashes (DataFrame operations only).

Units are the non-blank lines of a document, each a 64-bit hash with its
number of words: runs of characters other than ASCII white space, as in
``words``.  A line without words is blank.  Documents are ordered by id, then text hash.

1. Windows.  The window of a line is the shortest run of lines from it that
   holds ``min_words`` words, so any run of that many words, one long line or
   many short ones, holds a whole window.  The window's smallest line hash
   (the rightmost of equals) is its fingerprint.  Equal windows choose the
   same fingerprint at the same place: nothing of ``min_words`` words can
   repeat without sharing one.
2. Positions.  Each (fingerprint, window content) goes to its first
   occurrence, never to all others; consecutive windows of one repeat fall on
   one diagonal (document, earlier document, distance) and become one row.
3. Extension.  On each diagonal all lines of the later document are compared
   with the earlier one's; the stretches of equal lines around the
   fingerprints are the match, extended both ways as far as lines agree.
4. Deletion.  Matches of ``min_words`` words and more lose their later copy.

Every deleted line has an equal line earlier in the order, so a first copy
of each line stays.  A window's content that a third of the documents share
is handled as in exact dedup: counted per salt, then per group, and the first
occurrence goes back along the salts.  The join on a hot earlier document is
split by Spark's skew join.  What travels is narrow (hashes and positions);
texts travel once, to meet their deletions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed

MIN_WORDS = 50
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines: id, th (text hash), pos, idx, h, words, before."""
    text = F.col(text_col).cast("string")
    exploded = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("th"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    hashed = exploded.select(
        "id", "th", "pos", F.xxhash64("line").alias("h"),
        F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")).filter("words > 0")
    # a document that stands in several equal rows is one document
    once = hashed.dropDuplicates(["id", "th", "pos"])
    in_doc = Window.partitionBy("id", "th").orderBy("pos")
    ahead = in_doc.rowsBetween(Window.unboundedPreceding, -1)
    return once.select(
        "id", "th", "pos", "h", "words",
        (F.row_number().over(in_doc) - 1).alias("idx"),
        F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """id, th, idx (of the fingerprint), fp, content, one row per window."""
    stretch = Window.partitionBy("id", "th").orderBy("before").rangeBetween(0, min_words - 1)
    spread = lines.select(
        "id", "th", "idx", F.sum("words").over(stretch).alias("held"),
        F.collect_list("h").over(stretch).alias("hashes")).filter(F.col("held") >= min_words)
    smallest = F.array_min(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("fp"), (-i).alias("back"))))
    return spread.withColumn("least", smallest).select(
        "id", "th", (F.col("idx") - F.col("least.back")).alias("idx"),
        F.col("least.fp").alias("fp"), F.xxhash64("hashes").alias("content"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, salts: int = SALTS) -> DataFrame:
    """The lines to delete: id, th, pos."""
    lines = checkpointed(_lines(docs, id_col, text_col))
    windows = checkpointed(_windows(lines, min_words).withColumn(
        "salt", F.pmod(F.xxhash64("id", "th"), F.lit(salts)).cast("int")))

    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "th", "idx")
    salted = windows.groupBy("salt", "fp", "content").agg(
        F.min(place).alias("src"), F.count(F.lit(1)).alias("n"))
    salted = checkpointed(salted)
    first = salted.groupBy("fp", "content").agg(
        F.min("src").alias("src"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    back = salted.select("salt", "fp", "content").join(first, ["fp", "content"])
    diagonals = windows.join(back, ["salt", "fp", "content"]).select(
        "id", "th", F.col("src.id").alias("sid"), F.col("src.th").alias("sth"),
        (F.col("idx") - F.col("src.idx")).alias("diag"))
    same_doc = F.col("id").eqNullSafe(F.col("sid")) & (F.col("th") == F.col("sth"))
    diagonals = diagonals.filter(~(same_doc & (F.col("diag") == 0))).distinct()

    on = diagonals.alias("d").join(
        lines.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.th") == F.col("l.th"))
    ).select("d.id", "d.th", "d.sid", "d.sth", "d.diag", "l.pos", "l.idx", "l.words", "l.h",
             (F.col("l.idx") - F.col("d.diag")).alias("sidx"))
    source = lines.select(F.col("id").alias("oid"), F.col("th").alias("oth"),
                          F.col("idx").alias("oidx"), F.col("h").alias("oh"))
    equal = on.join(source, F.col("sid").eqNullSafe(F.col("oid")) & (F.col("sth") == F.col("oth"))
                    & (F.col("sidx") == F.col("oidx")) & (F.col("h") == F.col("oh")))
    diagonal = ["id", "th", "sid", "sth", "diag"]
    run = F.col("idx") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("idx"))
    matched = equal.withColumn("run", run).withColumn(
        "held", F.sum("words").over(Window.partitionBy(*diagonal, "run")))
    return matched.filter(F.col("held") >= min_words).select("id", "th", "pos").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, salts: int = SALTS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text_col``
    and one more column, ``_removed``, the number of deleted lines.

    Lines are compared exactly; blank lines belong to no run and stay.  A
    null text stays null, an empty one empty; a document of copies only
    becomes empty (or its blank lines).  A null id comes first in the order.
    Rows that repeat one id with one text are one document and get the same
    text; rows that repeat an id with other texts are documents of their own.
    Runs inside one document count too.  Other columns pass through; they
    must not be named ``_removed``, ``_rid`` or ``_rth``.  An empty table
    gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words, salts)
    in_doc = Window.partitionBy("id", "th").orderBy("pos")
    cuts = gone.withColumn("run", F.col("pos") - F.row_number().over(in_doc)) \
        .groupBy("id", "th", "run").agg(F.min("pos").alias("from"), F.max("pos").alias("to")) \
        .groupBy("id", "th").agg(F.collect_list(F.struct("from", "to")).alias("_cuts"),
                                 F.sum(F.col("to") - F.col("from") + 1).alias("_removed")) \
        .withColumnRenamed("id", "_rid").withColumnRenamed("th", "_rth")
    text = F.col(text_col).cast("string")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists(
        "_cuts", lambda c: (i >= c["from"]) & (i <= c["to"])))
    joined = docs.join(
        cuts.hint("shuffle_hash"),
        docs[id_col].eqNullSafe(cuts["_rid"]) & (F.xxhash64(text) == cuts["_rth"]), "left")
    return joined.select(*[
        F.when(F.col("_cuts").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c)
        if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("_removed", F.lit(0)).cast("long").alias("_removed"))
