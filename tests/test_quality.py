"""Q1-Q5 profiling and the load gate; streaming incremental load."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from revlens.operators.features import add_features
from revlens.operators.quality import (duplicate_rows, null_counts, profile_sheets,
                                       profile_shape, schema_summary, validate,
                                       validation_summary)
from revlens.sources.sinks import write_csv
from revlens.sources.tables import sales_fact


def test_duplicates_count_excess_copies_nulls_equal(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, None), (None, None)],
                               "a int, b string")
    assert duplicate_rows(df).first().duplicate_rows == 2


def test_duplicates_with_one_digest_are_compared_whole(spark):
    df = spark.createDataFrame([(i % 40, "x" if i % 3 else None) for i in range(200)], "a int, b string")
    want = 200 - df.distinct().count()
    assert duplicate_rows(df).first().duplicate_rows == want
    for clash in (lambda d: F.struct(F.lit(1).alias("a")), lambda d: F.struct((F.col("a") % 2).alias("a"))):
        assert duplicate_rows(df, digest=clash).first().duplicate_rows == want
    assert duplicate_rows(df.filter("a > 90")).first().duplicate_rows == 0
    swapped = spark.createDataFrame([(None, "a"), ("a", None), ("", None), (None, "")], "x string, y string")
    assert duplicate_rows(swapped).first().duplicate_rows == 0


def test_no_wide_row_is_shuffled_without_repeats(spark, tmp_path):
    wide = spark.range(2000).select("id", F.repeat(F.lit("wide text "), 50).alias("t"),
                                    F.sha2(F.col("id").cast("string"), 512).alias("u"))
    wide.write.parquet(str(tmp_path / "wide"))
    df = duplicate_rows(spark.read.parquet(str(tmp_path / "wide")))
    assert df.first().duplicate_rows == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_counts_include_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "c")], "x double, s string")
    got = {r.column: r.null_count for r in null_counts(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_shape_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    shape = profile_shape({"t": df}).first()
    assert (shape.dataset, shape.n_rows, shape.n_cols) == ("t", 2, 2)
    info = {r.column: (r.dtype, r.non_null) for r in schema_summary(df).collect()}
    assert info == {"a": ("int", 2), "b": ("string", 1)}


def test_zero_revenue_gives_null_margin_and_is_quarantined(spark, sf_dir):
    fact = sales_fact(spark, sf_dir).limit(5)
    zero = fact.withColumn("revenue", fact.revenue * 0).drop("total_cost", "profit",
                                                               "profit_margin_pct",
                                                               "order_month_name", "month_no")
    zero = add_features(zero).select(*fact.columns)
    assert zero.filter("profit_margin_pct IS NULL").count() == 5
    accepted, quarantined = validate(zero)
    assert accepted.count() == 0
    assert "profit_margin_pct:not_null" in quarantined.first().reasons


def test_validate_length_and_summary(spark, sf_dir):
    fact = sales_fact(spark, sf_dir).limit(3)
    long_name = fact.withColumn("customer_name", F.concat(F.lit("y" * 60), "customer_name"))
    _, bad = validate(long_name)
    assert bad.count() == 3
    summary = {(r.column, r.rule): r.violations for r in validation_summary(long_name).collect()}
    assert summary[("customer_name", "max_length")] == 3
    assert summary[("revenue", "not_null")] == 0


def test_incremental_load_exactly_once(spark, scratch, sf_dir):
    from revlens.streaming.incremental import incremental_load
    landing, table, quarantine, ckpt = (os.path.join(scratch, n) for n in ("in", "t", "q", "c"))
    fact = sales_fact(spark, sf_dir)
    write_csv(fact.limit(40), os.path.join(landing, "batch1"))
    q = incremental_load(spark, landing + "/*", table, quarantine, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 40
    q = incremental_load(spark, landing + "/*", table, quarantine, ckpt)   # restart: no new files
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 40
    loaded = spark.read.parquet(table).first()
    assert loaded.revenue is not None and isinstance(loaded.revenue, Decimal)


def test_profile_sheets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    got = {r.sheet: (r.n_rows, r.n_cols, r.null_cells, r.duplicate_rows)
           for r in profile_sheets({"A": a, "B": b}).collect()}
    assert got == {"A": (3, 2, 1, 1), "B": (2, 1, 1, 0)}
