"""Skewed data: one customer owns a third of the orders and one part a third
of the order lines.  Queries must still equal their oracles (and the plans
must not depend on the hot key fitting anywhere special)."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.oracle_check import compare

SKEW_QUERIES = ["b06_order_value_distribution", "b07_customer_ranking", "b10_rfm_segmentation",
                "b11_customer_lifetime_value", "b17_cost_efficiency", "d6_repeat_purchase",
                "w03_global_rank", "w05_global_ntile", "w08c_range_cumsum", "a11_median",
                "q03_duplicates"]


@pytest.fixture(scope="module")
def skewed_dir(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skew"))
    for t in ("customer", "part", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hot_customer = orders.agg(F.min("o_custkey")).first()[0]
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, hot_customer)
                               .otherwise(F.col("o_custkey")))
    orders.write.parquet(f"{out}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot_part = lines.agg(F.min("l_partkey")).first()[0]
    lines = lines.withColumn("l_partkey", F.when(F.col("l_linenumber") % 3 == 0, hot_part)
                             .otherwise(F.col("l_partkey")))
    lines.write.parquet(f"{out}/lineitem.parquet")
    return out


@pytest.fixture(scope="module")
def skew_duck(skewed_dir):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    return con


def test_hot_customer_really_is_hot(spark, skewed_dir):
    orders = spark.read.parquet(f"{skewed_dir}/orders.parquet")
    top = orders.groupBy("o_custkey").count().agg(F.max("count")).first()[0]
    assert top * 3 >= orders.count() * 0.99


@pytest.mark.parametrize("name", SKEW_QUERIES)
def test_skewed_query_matches_oracle(spark, skewed_dir, skew_duck, name):
    df = entry.queries()[name](spark, skewed_dir)
    ok, msg = compare(df, skew_duck.sql(entry.oracle_sql()[name]))
    assert ok, msg
