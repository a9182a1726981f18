"""Q1-Q5 — data profiling and the load gate, as DataFrames (one pass each).

The reference prints shapes, null counts and duplicate counts and relies on
the database to reject bad rows.  Here every profile is a distributed
aggregation whose (small) result is itself a DataFrame, and the gate splits
rows into accepted and quarantined with the reasons attached.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.ordered import materialize
from revlens.schema import MAX_TEXT_LENGTH, SALES_SCHEMA


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def profile_shape(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Q1: (dataset, n_rows, n_cols) for each named DataFrame."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"),
                    F.lit(len(df.columns)).cast("long").alias("n_cols"))
             for name, df in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def _is_missing(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _q(c).isNull() | F.isnan(_q(c))     # pandas counts NaN as missing
    return _q(c).isNull()


def _unpivot_one_row(row_df: DataFrame, names: list[str], value_name: str,
                     key_name: str = "column") -> DataFrame:
    return row_df.unpivot([], names, key_name, value_name)


def null_counts(df: DataFrame) -> DataFrame:
    """Q2: (column, null_count) in one aggregation pass."""
    names = df.columns
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in names])
    return _unpivot_one_row(counts, names, "null_count")


#: Digests that repeat, up to which they are sent to all tasks (16 bytes each).
BROADCAST_DIGESTS = 1 << 20


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row; NULLs count.  Equal rows have equal digests."""
    columns = [_q(c) for c in df.columns]
    empty = [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*columns, *empty).alias("a"),
                    F.xxhash64(F.lit("second"), *empty, *columns).alias("b"))


def duplicate_rows(df: DataFrame, digest: Callable[[DataFrame], Column] = row_digest) -> DataFrame:
    """Q3: number of excess full-row copies (pandas ``duplicated().sum()``:
    the first copy is not counted; NULLs compare equal).

    Two phases: first only a digest of 16 bytes a row is counted, with
    map-side combine, so the shuffle does not follow the rows' width and a row
    repeated a billion times is one entry a task.  Then the rows whose digest
    repeats, and no others, are compared whole, so two different rows with one
    digest are not taken for copies.  The first phase runs when this is
    called."""
    tagged = df.withColumn("_digest", digest(df))
    seen = tagged.groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    repeated = materialize(seen.filter("_rows > 1").select("_digest"))
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    suspects = tagged.join(repeated, "_digest", "left_semi")
    groups = suspects.groupBy("_digest", *[_q(c) for c in df.columns]) \
        .agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long")
                      .alias("duplicate_rows"))


def schema_summary(df: DataFrame) -> DataFrame:
    """Q4: (column, dtype, non_null) — ``df.info()`` without the memory line."""
    names = df.columns
    counts = df.agg(*[F.count(_q(c)).alias(c) for c in names])
    long = _unpivot_one_row(counts, names, "non_null")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtype = reduce(lambda acc, c: acc.when(F.col("column") == c, F.lit(types[c])),
                   names[1:], F.when(F.col("column") == names[0], F.lit(types[names[0]])))
    return long.select("column", dtype.alias("dtype"), "non_null")


CORRUPT_RECORD = "_corrupt_record"   # the CSV reader's column of malformed rows


def _rules(df: DataFrame, schema: T.StructType, max_len: int) -> list[tuple[str, str, Column]]:
    """(column, rule, violated?) for every check of the load gate."""
    rules = []
    for field in schema.fields:
        c = field.name
        if c not in df.columns:
            rules.append((c, "missing_column", F.lit(True)))
            continue
        if not field.nullable:
            rules.append((c, "not_null", _q(c).isNull()))
        if isinstance(field.dataType, T.StringType):
            rules.append((c, "max_length", F.length(_q(c)) > max_len))
        if df.schema[c].dataType != field.dataType:
            cast_fails = _q(c).isNotNull() & _q(c).try_cast(field.dataType).isNull()
            rules.append((c, "type", cast_fails))
    if CORRUPT_RECORD in df.columns:
        rules.append(("record", "malformed", _q(CORRUPT_RECORD).isNotNull()))
    return rules


def with_reasons(df: DataFrame, schema: T.StructType = SALES_SCHEMA,
                 max_len: int = MAX_TEXT_LENGTH) -> DataFrame:
    """``df`` with ``reasons: array<string>``, the rules each row violates."""
    rules = _rules(df, schema, max_len)
    return df.withColumn("reasons", F.filter(
        F.array(*[F.when(bad, F.lit(f"{c}:{rule}")) for c, rule, bad in rules]),
        lambda x: x.isNotNull()))


def split_by_reasons(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows of a table tagged by ``with_reasons``."""
    return (tagged.filter(F.size("reasons") == 0).drop("reasons", CORRUPT_RECORD),
            tagged.filter(F.size("reasons") > 0))


def validate(df: DataFrame, schema: T.StructType = SALES_SCHEMA,
             max_len: int = MAX_TEXT_LENGTH, mode: str = "quarantine"):
    """Q5: the table gate (NOT NULL, NVARCHAR(50) length, castable type, and no
    ``_corrupt_record`` where the reader kept one).

    Returns ``(accepted, quarantined)``; quarantined rows carry
    ``reasons: array<string>`` like ``'revenue:not_null'``.  With
    ``mode='fail'`` any violation raises (the bulk load would abort)."""
    accepted, quarantined = split_by_reasons(with_reasons(df, schema, max_len))
    if mode == "fail":
        first = quarantined.select("reasons").limit(1).collect()
        if first:
            raise ValueError(f"validation failed: {first[0]['reasons']}")
    elif mode != "quarantine":
        raise ValueError("mode must be 'quarantine' or 'fail'")
    return accepted, quarantined


def validation_summary(df: DataFrame, schema: T.StructType = SALES_SCHEMA,
                       max_len: int = MAX_TEXT_LENGTH) -> DataFrame:
    """Q5 as a report: (column, rule, violations) for every check, one pass."""
    rules = _rules(df, schema, max_len)
    names = [f"{c}:{rule}" for c, rule, _ in rules]
    counts = df.agg(*[F.count_if(bad).alias(n) for n, (_, _, bad) in zip(names, rules)])
    long = _unpivot_one_row(counts, names, "violations", "check")
    parts = F.split("check", ":")
    return long.select(parts[0].alias("column"), parts[1].alias("rule"), "violations")


def profile_sheets(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Q1-Q3 for a whole workbook: (sheet, n_rows, n_cols, null_cells,
    duplicate_rows) — the notebook's first look at its sheets, one row per
    sheet, each computed by distributed aggregations."""
    parts = []
    for name, df in sheets.items():
        nulls = reduce(lambda a, b: a + b,
                       [F.count_if(_is_missing(df, c)) for c in df.columns], F.lit(0))
        stats = df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.cast("long").alias("null_cells"))
        dups = duplicate_rows(df).scalar()           # scalar subquery, stays lazy
        parts.append(stats.select(F.lit(name).alias("sheet"), "n_rows",
                                  F.lit(len(df.columns)).cast("long").alias("n_cols"),
                                  "null_cells", dups.alias("duplicate_rows")))
    return reduce(DataFrame.unionByName, parts)
