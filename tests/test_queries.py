"""Every registered query against its DuckDB oracle on sf0.001, plus plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from revlens.plans.registry import all_oracles, all_queries
from revlens.sources.tables import sales_fact
from tools.oracle_check import TABLES, compare

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "Customer_Segment" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_plan_reads_only_needed_columns_and_lookups(spark, sf_dir):
    plan = _plan(QUERIES["b03_top_products_revenue"](spark, sf_dir))
    assert "orders.parquet" not in plan and "customer.parquet" not in plan
    formatted = QUERIES["b03_top_products_revenue"](spark, sf_dir)._jdf.queryExecution() \
        .simpleString()
    assert "struct<l_partkey:bigint,l_quantity:double>" in formatted


def test_geography_is_broadcast_at_run_time(spark, sf_dir):
    """No join is forced; AQE sees that the 25 nations are small."""
    geo = sales_fact(spark, sf_dir, columns=("state_name", "us_region"))
    geo.collect()
    assert "BroadcastHashJoin" in _plan(geo)


def test_channel_share_aggregates_before_shuffle(spark, sf_dir):
    plan = QUERIES["b05_channel_share"](spark, sf_dir)._jdf.queryExecution().simpleString()
    assert "partial_sum" in plan


def test_partition_count_invariance(spark, sf_dir):
    q = QUERIES["b07_customer_ranking"]
    before = sorted(q(spark, sf_dir).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        after = sorted(q(spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert before == after


SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, sf_dir, duck, name):
    rel = duck.sql(ORACLES[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, dtype in QUERIES[name](spark, sf_dir).dtypes:
        assert duck_types.get(col) == SPARK_TO_DUCK.get(dtype, dtype), (col, dtype)


@pytest.mark.parametrize("name", ["b07_customer_ranking", "b10_rfm_segmentation",
                                  "w04_partitioned_rank", "j_star_enrich"])
def test_queries_hold_under_other_session_settings(spark, sf_dir, duck, name):
    """The driver's session may differ: ANSI off, AQE off, many partitions."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled",
                                            "spark.sql.adaptive.enabled",
                                            "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        ok, msg = compare(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert ok, msg
