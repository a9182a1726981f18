"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revlens.session import ensure_checkpoint_dir

PACKAGE = Path(__file__).resolve().parent.parent
#: Removes a run's shuffle files at its end; Spark has it since 4.1, others ignore it.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_release = threading.Lock()
#: Bounds a batch of rows for a Python worker by its bytes too; 10 000 rows of long
#: texts else make tens of MB, held by the task and by the worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that the
    session names in ``spark.checkpoint.dir``; a lost executor re-reads it.
    The shuffle files behind it go once it is written: nothing reads them
    again, and else they stay until the driver collects its garbage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _release:
        before = spark.conf.get(RELEASE, "false")
        spark.conf.set(RELEASE, "true")
        try:        # holds for frames made meanwhile; ``df`` may run again and keeps its own
            once = df.select("*")
        finally:
            spark.conf.set(RELEASE, before)
    return once.checkpoint(eager=True)


def checkpointed_count(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` checkpointed, and its number of rows (or of those that satisfy
    ``what``), counted by the job that writes them; 0 only if there is none."""
    seen = Observation()
    counted = F.count(F.lit(1)) if what is None else F.count_if(what)
    out = checkpointed(df.observe(seen, counted.alias("n")))
    return out, seen.get["n"]


def ship_package(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once; they import the
    functions that operators send them, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_revlens_shipped", False) or not PACKAGE.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="revlens-")) / "revlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._revlens_shipped = True


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on the session's Python workers get batches of about ``most``
    bytes, unless the session names a bound itself."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_of(column: str) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def md5_fraction(key: Column) -> Column:
    """A uniform draw in (0, 1) from the first 48 bits of the key's MD5."""
    bits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(2 ** 48)


def spread_lookup(rows: DataFrame, keys: list[str], answers: DataFrame, spread_by: str,
                  salts: int = 256) -> DataFrame:
    """``rows`` joined to their one row of ``answers`` per key, with a key that
    holds a large part of the rows spread over ``salts`` tasks: the answers go
    to the distinct (salt, key), at most ``salts`` a key, and these to the
    rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    met = salted.select("_salt", *keys).distinct().join(answers, keys)
    return salted.join(met, ["_salt", *keys]).drop("_salt")
