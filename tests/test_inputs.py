"""Tables that change between two calls, and values a lookup must not lose."""

import shutil

from pyspark.sql import functions as F

from revlens.operators.joins import dedupe_first
from revlens.plans.operator_queries import pivot_api
from revlens.sources.tables import sales_fact


def test_rows_added_in_the_session_are_seen(spark, sf_dir, tmp_path):
    for name in ("lineitem", "orders", "customer", "part", "nation", "region"):
        (tmp_path / f"{name}.parquet").mkdir()
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet" / "a.parquet")
    before = sales_fact(spark, str(tmp_path)).count()
    shutil.copy(f"{sf_dir}/lineitem.parquet", tmp_path / "lineitem.parquet" / "b.parquet")
    assert sales_fact(spark, str(tmp_path)).count() == 2 * before


def test_dedupe_first_keeps_values_without_an_order(spark):
    dim = spark.createDataFrame(
        [(1, "x", None), (2, "late", 9), (2, "first", 3), (2, "none", None), (3, "b", 1), (3, "a", 1)],
        "k int, v string, o int")
    got = {r.k: (r.v, r.o) for r in dedupe_first(dim, "k", "o").collect()}
    assert got == {1: ("x", None), 2: ("first", 3), 3: ("a", 1)}


def test_pivot_keeps_rows_without_a_date(spark, sf_dir, monkeypatch):
    fact = sales_fact(spark, sf_dir, columns=("month_no", "order_month_name", "order_date",
                                              "revenue"))
    first = F.col("month_no") == 1
    holed = fact.withColumns({c: F.when(~first, F.col(c))
                              for c in ("order_date", "month_no", "order_month_name")})
    monkeypatch.setattr("revlens.plans.operator_queries.sales_fact", lambda *a, **k: holed)
    rows = {r.Month_Num: r.All_Years_Total_M for r in pivot_api(spark, sf_dir).collect()}
    assert None in rows and 1 not in rows and rows[None] > 0
