"""Exact deduplication by skew-safe combining (DataFrame operations only).

Equal texts form a group.  The combining runs in three stages, and each of
them groups by the digest *and* the whole text, so a digest collision can
never merge two different texts:

1. local: Spark's partial aggregation drops copies inside each input task;
2. salted: what is left meets per (salt, digest, text), the salt coming from
   the row's id, so a group that holds a third of all rows is spread over
   ``salts`` keys;
3. global: at most ``salts`` winners a group meet per (digest, text).

The answer for every row comes back along the same tree and is narrow: the
global winners go to the (salt, digest) groups, and these to the rows.  No
key of either join holds more than ``salts`` rows, or a salt's share of a
group.  A digest with more than one text (a collision) is found by the global
stage; only the rows of such digests are joined by their whole text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, text_of

SALTS = 256


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per input row: ``id``, ``digest``, ``keep_id`` (the largest id
    among the rows with the same text), ``group_size`` and ``kept``.

    Null text counts as empty, so it is equal to an empty text.  A null id is
    smaller than any other; a group of null ids only keeps the null id.  Rows
    that repeat one id with one text count each, and share one answer.  Other
    columns of ``docs`` are ignored, whatever their names.  An empty table
    gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    with_digest = source.select("id", "text", digest(F.col("text")).alias("digest"),
                                salt.alias("salt"))
    rows = checkpointed(with_digest.select("id", "digest", "salt"))

    salted = with_digest.groupBy("salt", "digest", "text").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = checkpointed(
        salted.groupBy("digest", "text").agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size")))

    one_text = winners.filter("texts = 1").drop("texts")
    spread = rows.select("salt", "digest").distinct().join(one_text, "digest")
    found = rows.join(spread, ["salt", "digest"]).select("id", "digest", "keep_id", "group_size")

    collided = winners.filter("texts > 1").select("digest")
    if not collided.isEmpty():
        suspects = with_digest.join(collided, "digest", "left_semi")
        merged = (suspects.groupBy("salt", "digest", "text")
                  .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        whole = merged.groupBy("digest", "text").agg(
            F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        back = merged.select("salt", "digest", "text").join(whole, ["digest", "text"])
        found = found.unionByName(
            suspects.join(back, ["salt", "digest", "text"])
            .select("id", "digest", "keep_id", "group_size"))
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id stays, all columns.  Several rows that
    repeat the staying id with the staying text all stay: they are one
    document."""
    stays = exact_groups(docs, id_col, text_col, **params).filter("kept") \
        .select(F.col("id").alias("_kept_id")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_kept_id"]), "left_semi")
