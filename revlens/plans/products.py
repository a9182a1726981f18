"""Product reports: B3 top products by revenue, B4 top products by mean
margin, B12 year-over-year growth, B17 cost efficiency, B18 ABC / Pareto.

Each ``*_from`` function takes per-product (or product-year) measures —
``_rev``, ``_cost``, ``_margin_sum``, ``_margin_n`` — and re-aggregates them
to its key, so it accepts either a minimal aggregate of the fact (the
single-report path) or the shared ``product_year`` grain (``plans.suite``).
B17 and B18 then order the product table with the size-checked operators of
``revlens.operators.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.semantics import (MILLION, THOUSAND, dec_lit, first_match, pct_change,
                                         pct_label, safe_div, scale_round, scale_round_dec,
                                         snap_round)
from revlens.operators.ordered import materialize, with_range_cumsum, with_rank
from revlens.plans.common import reads
from revlens.plans.grains import margin_mean


def product_measures(sales: DataFrame, cost: bool = False, margin: bool = False,
                     by_year: bool = False) -> DataFrame:
    """Per product (and year) revenue, optionally total cost and margin sum/count."""
    aggs = [F.sum("revenue").alias("_rev")]
    if cost:
        aggs.append(F.sum("total_cost").alias("_cost"))
    if margin:
        aggs += [F.sum("profit_margin_pct").alias("_margin_sum"),
                 F.count("profit_margin_pct").alias("_margin_n")]
    keys = [F.col("product_name").alias("Product")]
    if by_year:
        keys.append(F.year("order_date").alias("Year"))
    return sales.groupBy(*keys).agg(*aggs)


@reads("product_name", "revenue")
def top_products_by_revenue(sales: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` products with the largest revenue (millions, 2 dp).
    Ties on the rounded value are broken by product name."""
    return top_products_by_revenue_from(product_measures(sales), n)


def top_products_by_revenue_from(measures: DataFrame, n: int = 10) -> DataFrame:
    return (measures.groupBy(F.col("Product").alias("Products"))
            .agg(scale_round(F.sum("_rev"), MILLION, 2).alias("Total_Sales_Value"))
            .orderBy(F.desc("Total_Sales_Value"), "Products").limit(n))


@reads("product_name", "profit_margin_pct")
def top_products_by_margin(sales: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` products with the highest *unweighted* mean row margin."""
    return top_products_by_margin_from(
        sales.groupBy(F.col("product_name").alias("Product")).agg(
            F.sum("profit_margin_pct").alias("_margin_sum"),
            F.count("profit_margin_pct").alias("_margin_n")), n)


def top_products_by_margin_from(measures: DataFrame, n: int = 10) -> DataFrame:
    return (measures.groupBy("Product")
            .agg(snap_round(margin_mean(), 2).alias("Profit_Margin"))
            .orderBy(F.desc("Profit_Margin"), "Product").limit(n))


@reads("product_name", "order_date", "revenue")
def yoy_growth(sales: DataFrame) -> DataFrame:
    """Revenue per product and year (thousands, 1 dp) and the growth
    against the product's previous year *present* ('Base Year' for the first;
    a zero base gives ' %')."""
    return yoy_growth_from(product_measures(sales, by_year=True))


def yoy_growth_from(measures: DataFrame) -> DataFrame:
    yearly = measures.groupBy("Product", "Year") \
        .agg(scale_round(F.sum("_rev"), THOUSAND, 1).alias("Revenue_K"))
    prev = F.lag("Revenue_K").over(Window.partitionBy("Product").orderBy("Year"))
    yearly = yearly.withColumn("_prev", prev)
    growth = first_match([(F.col("_prev").isNull(), "Base Year")],
                         pct_label(snap_round(pct_change("Revenue_K", "_prev"), 1), " %"))
    return yearly.select("Product", F.col("Year").cast("long").alias("Year"), "Revenue_K",
                         growth.alias("YoY_Growth")).orderBy("Product", "Year")


@reads("product_name", "revenue", "total_cost", "profit_margin_pct")
def cost_efficiency(sales: DataFrame) -> DataFrame:
    """Revenue per cost dollar per product, ranked on the unrounded ratio."""
    return cost_efficiency_from(product_measures(sales, cost=True, margin=True))


def cost_efficiency_from(measures: DataFrame) -> DataFrame:
    per = measures.groupBy("Product").agg(
        F.sum("_rev").alias("_rev"), F.sum("_cost").alias("_cost"),
        margin_mean().alias("_margin"))
    per = per.withColumn("_ratio", safe_div(F.col("_rev").cast("double"),
                                            F.col("_cost").cast("double")))
    per = with_rank(materialize(per), "_ratio", desc=True, name="Efficiency_Rank")
    return per.select(
        "Product",
        scale_round("_rev", MILLION, 2).alias("Revenue_M"),
        scale_round("_cost", MILLION, 2).alias("Total_Cost_M"),
        snap_round("_ratio", 3).alias("Revenue_Per_Cost_Dollar"),
        snap_round("_margin", 2).alias("Avg_Margin_Pct"),
        F.col("Efficiency_Rank").cast("long").alias("Efficiency_Rank"),
    ).orderBy("Efficiency_Rank", "Product")


# ABC cut-offs (inclusive) and labels of the Pareto report.
ABC_CUTS = (("0.70", "A — Core"), ("0.90", "B — Support"))
ABC_OTHER = "C — Review"


@reads("product_name", "revenue")
def abc_pareto(sales: DataFrame, cuts=ABC_CUTS, other: str = ABC_OTHER) -> DataFrame:
    """ABC classes from the running share of product revenue.

    Running and grand totals add the 2-dp rounded millions; tied revenues
    share one running total (RANGE frame).  Class cuts compare exactly in
    DECIMAL: ``running <= cut * total``."""
    return abc_pareto_from(product_measures(sales), cuts, other)


def abc_pareto_from(measures: DataFrame, cuts=ABC_CUTS, other: str = ABC_OTHER) -> DataFrame:
    per = measures.groupBy("Product").agg(scale_round_dec(F.sum("_rev"), MILLION, 2).alias("_rm"))
    per = with_range_cumsum(materialize(per), "_rm", "_rm", desc=True, name="_cum")
    total = per.agg(F.sum("_rm")).scalar()             # scalar subquery, one row
    per = per.withColumn("_total", total)
    cls = first_match([(F.col("_cum") <= F.col("_total") * dec_lit(c), label)
                       for c, label in cuts], other)
    pct = snap_round(F.col("_cum").cast("double") / F.col("_total").cast("double") * 100, 1)
    return per.select("Product", F.col("_rm").cast("double").alias("Revenue_M"),
                      pct.alias("Cumulative_Pct"), cls.alias("ABC_Class")) \
        .orderBy(F.desc("Revenue_M"), "Product")
