"""Publishing a load: staged parts and a manifest that readers follow.

A load has two results, the accepted rows and the quarantined ones, and Spark
commits each write on its own.  So that both appear together or not at all,
they are written to folders of their own version, which no reader knows, and
then one row is appended to the table's manifest: Spark moves that one file
into place when its write commits.  A reader takes the newest row.  A load
that dies before leaves the earlier version as it was; its folders stay behind
unread, and the next load has a version of its own.

    <table>/manifest/part-*.json   {"version", "published", "part": path, ...}
    <table>/versions/<version>/<part>
"""

from __future__ import annotations

import time
import uuid
from typing import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "version string, published double, parts map<string, string>"


def _at(table: str, name: str) -> str:
    return f"{table.rstrip('/')}/{name}"


def publish(spark: SparkSession, table: str, parts: Mapping[str, Callable[[str], None]],
            folders: Mapping[str, str] | None = None) -> str:
    """Writes every part by its function, which takes the path, and then names
    them all in the manifest; returns the version.  ``folders`` puts a part's
    versions elsewhere."""
    version = uuid.uuid4().hex
    paths = {name: _at((folders or {}).get(name, _at(table, "versions")), f"{version}/{name}")
             for name in parts}
    for name, write in parts.items():
        write(paths[name])
    row = spark.createDataFrame([(version, time.time(), paths)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").json(_at(table, "manifest"))
    return version


def published(spark: SparkSession, table: str) -> dict[str, str] | None:
    """The parts of the newest version, or None where nothing was published."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(_at(table, "manifest"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = rows.agg(F.max_by("parts", F.struct("published", "version"))).first()[0]
    return dict(newest) if newest else None


def read_part(spark: SparkSession, table: str, part: str) -> DataFrame:
    """One part of the newest version."""
    parts = published(spark, table)
    if not parts or part not in parts:
        raise FileNotFoundError(f"{table} has no published {part}")
    return spark.read.parquet(parts[part])
