"""Edge rows of the report semantics (FIXTURES §4), on hand-made frames."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.semantics import (half_even, month_boundaries, pct_label, scale_round,
                                         snap_round)
from revlens.plans import channels, customers, orders, products, trend
from revlens.plans.customers import recency_score, rfm_segment


def _sales(spark, rows):
    """Minimal fact frame: (order_number, order_date, customer, product, revenue)."""
    schema = T.StructType([
        T.StructField("order_number", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("revenue", T.DecimalType(18, 2)),
    ])
    return spark.createDataFrame([(o, d, c, p, Decimal(str(r))) for o, d, c, p, r in rows], schema)


def test_first_month_has_no_previous_and_label_is_bare_percent(spark):
    df = _sales(spark, [("1", date(2014, 1, 5), "a", "p", 1_000_000)])
    row = trend.monthly_trend(df).collect()[0]
    assert row.Previous_Month_Revenue is None
    assert row.Difference == "%"


def test_missing_month_compares_to_previous_row(spark):
    df = _sales(spark, [("1", date(2014, 1, 5), "a", "p", 1_000_000),
                        ("2", date(2014, 3, 5), "a", "p", 1_500_000)])
    rows = trend.monthly_trend(df).collect()
    assert [r.Month for r in rows] == [1, 3]
    assert rows[1].Previous_Month_Revenue == 1.0
    assert rows[1].Difference == "50%"


@pytest.mark.parametrize("total,label", [
    ("99999.99", "Below 100k"), ("100000", "100k to 200k"), ("200000", "200k to 400k"),
    ("400000", "400k to 600k"), ("600000", "600k to 700k"), ("699999.99", "600k to 700k"),
    ("700000", "Above 700k "), (None, "Above 700k ")])
def test_order_value_bucket_edges(spark, total, label):
    df = spark.createDataFrame([(None if total is None else Decimal(total),)],
                               "t decimal(18,2)")
    assert df.select(orders.order_value_bucket("t").alias("b")).first().b == label


@pytest.mark.parametrize("days,score", [(0, 5), (1, 4), (2, 4), (3, 3), (5, 3), (6, 2), (9, 2),
                                        (10, 1)])
def test_recency_score_edges(spark, days, score):
    df = spark.createDataFrame([(days,)], "r int")
    assert df.select(recency_score("r").alias("s")).first().s == score


@pytest.mark.parametrize("rfm,segment", [
    ((5, 4, 4), "Champion"), ((5, 1, 5), "Loyal Customer"), ((1, 1, 1), "Developing"),
    ((5, 2, 3), "New Customer"), ((3, 3, 3), "Potential Loyalist"),
    ((2, 4, 2), "Needs Attention"), ((1, 3, 1), "Developing")])
def test_segment_rules_first_match(spark, rfm, segment):
    df = spark.createDataFrame([rfm], "r int, f int, m int")
    seg = rfm_segment(F.col("r") + F.col("f") + F.col("m"), F.col("f"), F.col("m"))
    assert df.select(seg.alias("s")).first().s == segment


def test_month_boundaries_counts_calendar_crossings(spark):
    df = spark.createDataFrame([(date(2014, 1, 31), date(2014, 2, 1)),
                                (date(2014, 1, 1), date(2014, 1, 31)),
                                (date(2013, 12, 31), date(2015, 1, 1))], "a date, b date")
    got = [r.m for r in df.select(month_boundaries("a", "b").alias("m")).collect()]
    assert got == [1, 0, 13]


def test_single_month_customer_has_no_clv_and_sorts_last(spark):
    df = _sales(spark, [("1", date(2014, 1, 2), "one", "p", 100),
                        ("2", date(2014, 1, 30), "one", "p", 100),
                        ("3", date(2014, 1, 2), "many", "p", 100),
                        ("4", date(2014, 3, 2), "many", "p", 100)])
    rows = customers.customer_lifetime_value(df).collect()
    assert [r.Customer for r in rows] == ["many", "one"]
    assert rows[1].Orders_Per_Month is None and rows[1].Projected_Annual_CLV_K is None
    assert rows[0].Active_Months == 2 and rows[0].Orders_Per_Month == 1.0


def test_base_year_and_zero_previous(spark):
    df = _sales(spark, [("1", date(2014, 1, 1), "a", "p", 0), ("2", date(2015, 1, 1), "a", "p", 5000)])
    rows = products.yoy_growth(df).collect()
    assert rows[0].YoY_Growth == "Base Year"
    assert rows[1].YoY_Growth == " %"


def test_pareto_ties_share_running_total_and_cuts_are_inclusive(spark):
    df = _sales(spark, [("1", date(2014, 1, 1), "a", "x", 5_000_000),
                        ("2", date(2014, 1, 1), "a", "y", 5_000_000),
                        ("3", date(2014, 1, 1), "a", "z", 3_000_000)])
    rows = {r.Product: r for r in products.abc_pareto(df).collect()}
    assert rows["x"].Cumulative_Pct == rows["y"].Cumulative_Pct == round(10 / 13 * 100, 1)
    assert rows["z"].Cumulative_Pct == 100.0
    df2 = _sales(spark, [("1", date(2014, 1, 1), "a", "a", 7_000_000),
                         ("2", date(2014, 1, 1), "a", "b", 2_000_000),
                         ("3", date(2014, 1, 1), "a", "c", 1_000_000)])
    classes = {r.Product: r.ABC_Class for r in products.abc_pareto(df2).collect()}
    assert classes == {"a": "A — Core", "b": "B — Support", "c": "C — Review"}


def test_rolling_start_and_running_restart(spark):
    df = _sales(spark, [("1", date(2014, 10, 1), "a", "p", 3_000_000),
                        ("2", date(2014, 11, 1), "a", "p", 6_000_000),
                        ("3", date(2014, 12, 1), "a", "p", 9_000_000),
                        ("4", date(2015, 1, 1), "a", "p", 1_000_000)])
    rows = trend.rolling_averages(df).collect()
    assert [r.Rolling_3M_Avg_M for r in rows] == [3.0, 4.5, 6.0, 5.33]
    assert [r.Running_Avg for r in rows] == [3.0, 4.5, 6.0, 1.0]


def test_pivot_absent_year_is_zero_and_total_counts_unlisted(spark):
    df = _sales(spark, [("1", date(2014, 2, 1), "a", "p", 1_000_000),
                        ("2", date(2013, 2, 1), "a", "p", 2_000_000)])
    df = df.withColumns({"month_no": F.month("order_date"),
                         "order_month_name": F.date_format("order_date", "MMMM")})
    row = trend.month_year_pivot(df, years=(2014, 2015)).first()
    assert row["2015_M"] == 0.0 and row["2014_M"] == 1.0 and row.All_Years_Total_M == 3.0


def test_channel_share_uses_rounded_figures(spark):
    schema = "channel string, revenue decimal(18,2)"
    df = spark.createDataFrame([("A", Decimal("1040000")), ("B", Decimal("2040000"))], schema)
    rows = {r.Channel: r for r in channels.channel_share(df).collect()}
    assert rows["A"].Total_Revenue == 1.0 and rows["B"].Total_Revenue == 2.0
    assert rows["A"].Contribution == "32.26 %"      # 1.0 / 3.1 with the total rounded first


def test_rounding_half_even_vs_half_up(spark):
    df = spark.createDataFrame([(Decimal("0.125"),)], "x decimal(18,4)")
    row = df.select(half_even("x").alias("e"), F.round("x", 2).alias("u")).first()
    assert row.e == Decimal("0.12") and row.u == Decimal("0.13")


def test_snap_round_resolves_decimal_ties(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (2.675,)], "x double")
    got = [r.s for r in df.select(snap_round("x", 2).alias("s")).collect()]
    assert got == [1.01, 0.29, 2.68]


def test_pct_label_strips_trailing_zero(spark):
    df = spark.createDataFrame([(5.0,), (54.2,), (None,)], "x double")
    got = [r.s for r in df.select(pct_label("x", " %").alias("s")).collect()]
    assert got == ["5 %", "54.2 %", " %"]


def test_scale_round_is_exact_decimal(spark):
    df = spark.createDataFrame([(Decimal("1234549.99"),), (Decimal("1250000.00"),)], "x decimal(18,2)")
    got = [r.s for r in df.select(scale_round("x", "0.000001", 1).alias("s")).collect()]
    assert got == [1.2, 1.3]


def test_month_name_is_english_and_locale_free(spark):
    from revlens.functions.semantics import month_name
    df = spark.createDataFrame([(date(2014, m, 3),) for m in range(1, 13)] + [(None,)], "d date")
    got = [r.n for r in df.select(month_name("d").alias("n")).collect()]
    assert got[:3] == ["January", "February", "March"] and got[11] == "December"
    assert got[12] is None
