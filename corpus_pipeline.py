"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes what its predecessor kept, as written to Parquet, and its
decisions take effect: rejected documents and copies go, repeated runs of
lines are cut out.  ``ORACLE_SQL`` is None: SQL cannot express the trained
classifier, the MinHash stage or the encoding; tests hold the stages against
brute force instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, line_dedup, near_dup, pieces, quality
from revlens.llm.common import bound_batches, table
from revlens.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on them, does not reject."""
    bound_batches(spark)
    trained = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, trained)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of 50 words and more in whole lines.
    One of which nothing but blank lines is left goes; ``n_chars`` follows
    the text."""
    cut = line_dedup.dedup_lines(docs)
    emptied = (F.col("_removed") > 0) & ~F.col("text").rlike(line_dedup.WORD)
    kept = cut.filter(~emptied)
    length = F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component;
    rows that repeat an id with other texts are judged each by its own."""
    bound_batches(spark)
    return near_dup.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    bound_batches(spark)
    encoded = pieces.encode(docs.select("doc_id", "text"), pieces.load())
    return pieces.token_counts(encoded).select("doc_id", "n_tokens", "token_ids")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the
    shared checkpoint folder and read again by the next one."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        at = f"{shared}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
