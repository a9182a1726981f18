"""D1-D7 — tables the reference describes in prose only (formulas are ours).

D1 headline KPIs, D2 region performance, D3 RFM segment mix, D4 product
quadrants (margin x volume), D5 customers below mean / median, D6 repeat
purchase share, D7 ABC class mix.  Each has a ``*_from`` form over grain
aggregates or over the report it summarises (used by ``plans.suite``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.semantics import MILLION, safe_div, scale_round, snap_round
from revlens.operators.ordered import materialize, percentile_values
from revlens.plans.common import reads
from revlens.plans.customers import RECENCY_BOUNDS, customer_ranking, rfm_segmentation
from revlens.plans.grains import margin_mean
from revlens.plans.products import ABC_CUTS, abc_pareto


@reads("order_number", "customer_name", "revenue", "profit")
def headline_kpis(sales: DataFrame, approx_distinct: bool = False, rsd: float = 0.01) -> DataFrame:
    """One row — revenue, profit, weighted margin, orders, customers.

    One pass over the fact: it is first summed per (order, customer), and the
    two sums and the two exact distinct counts are taken from these rows, so
    the rows that Spark repeats for a second distinct count are orders and not
    order lines.  NULL is no order and no customer.  With
    ``approx_distinct=True`` (opt-in) the counts are HyperLogLog++ sketches
    (``approx_count_distinct``, relative standard deviation ``rsd``): no
    shuffle of the keys."""
    sums = [F.sum("revenue").alias("_rev"), F.sum("profit").alias("_profit")]
    if approx_distinct:
        row = sales.agg(*sums, F.approx_count_distinct("order_number", rsd).alias("Orders"),
                        F.approx_count_distinct("customer_name", rsd).alias("Customers"))
    else:
        row = sales.groupBy("order_number", "customer_name").agg(*sums).agg(
            F.sum("_rev").alias("_rev"), F.sum("_profit").alias("_profit"),
            F.count_distinct("order_number").alias("Orders"),
            F.count_distinct("customer_name").alias("Customers"))
    return _kpi_columns(row)


def _kpi_columns(row: DataFrame) -> DataFrame:
    return row.select(
        F.col("_rev").cast("double").alias("Total_Revenue"),
        F.round("_profit", 2).cast("double").alias("Total_Profit"),
        snap_round(safe_div(F.col("_profit").cast("double"), F.col("_rev").cast("double")) * 100,
                   2).alias("Profit_Margin_Pct"),
        "Orders", "Customers")


def headline_kpis_from(measures: DataFrame, customers: DataFrame, orders: DataFrame) -> DataFrame:
    """D1 from revenue/profit measures at any grain and one row per customer
    (``Customer``) and per order (``order_number``)."""
    n_orders = orders.agg(F.count("order_number")).scalar()
    n_customers = customers.agg(F.count("Customer")).scalar()
    return _kpi_columns(measures.agg(F.sum("_rev").alias("_rev"), F.sum("_profit").alias("_profit"))
                        .withColumns({"Orders": n_orders, "Customers": n_customers}))


@reads("us_region", "revenue")
def region_performance(sales: DataFrame) -> DataFrame:
    """Revenue per region (millions, 1 dp) and its share of the total."""
    return region_performance_from(
        sales.groupBy("us_region").agg(F.sum("revenue").alias("_rev")))


def region_performance_from(measures: DataFrame) -> DataFrame:
    per = measures.groupBy(F.col("us_region").alias("Region")).agg(F.sum("_rev").alias("_rev"))
    total = F.sum("_rev").over(Window.partitionBy())     # bounded: one row per region
    share = snap_round(safe_div(F.col("_rev").cast("double"), total.cast("double")) * 100, 1)
    return per.select("Region", scale_round("_rev", MILLION, 1).alias("Revenue_M"),
                      share.alias("Share_Pct")).orderBy(F.desc("Revenue_M"), "Region")


@reads("customer_name", "order_date", "order_number", "revenue")
def rfm_segment_mix(sales: DataFrame, recency_bounds=RECENCY_BOUNDS) -> DataFrame:
    """D3: customers, monetary total (thousands) and mean frequency per segment."""
    return rfm_segment_mix_from(rfm_segmentation(sales, recency_bounds))


def rfm_segment_mix_from(rfm: DataFrame) -> DataFrame:
    return rfm.groupBy("Customer_Segment").agg(
        F.count(F.lit(1)).alias("Customers"),
        F.sum(F.col("Monetary_000s").cast("decimal(18,2)")).cast("double").alias("Monetary_000s"),
        snap_round(F.sum("Frequency").cast("double") / F.count("Frequency"), 2)
        .alias("Avg_Frequency")).orderBy(F.desc("Customers"), "Customer_Segment")


@reads("product_name", "revenue", "profit_margin_pct")
def product_quadrants(sales: DataFrame) -> DataFrame:
    """Each product's revenue and mean margin against the product medians:
    'High Margin' / 'Low Margin' x 'High Volume' / 'Low Volume'."""
    return product_quadrants_from(sales.groupBy(F.col("product_name").alias("Product")).agg(
        F.sum("revenue").alias("_rev"), F.sum("profit_margin_pct").alias("_margin_sum"),
        F.count("profit_margin_pct").alias("_margin_n")))


def product_quadrants_from(measures: DataFrame) -> DataFrame:
    per = materialize(measures.groupBy("Product").agg(
        F.sum("_rev").cast("double").alias("_rev"), margin_mean().alias("_margin")))
    medians = percentile_values(per, {"_rev": [0.5], "_margin": [0.5]})   # in shared passes
    med_rev, med_margin = (F.lit(medians[c][0]).cast("double") for c in ("_rev", "_margin"))
    margin_label = F.when(F.col("_margin") >= med_margin, "High Margin").otherwise("Low Margin")
    volume_label = F.when(F.col("_rev") >= med_rev, "High Volume").otherwise("Low Volume")
    return per.select(
        "Product", snap_round(F.col("_rev") / 1e6, 2).alias("Revenue_M"),
        snap_round("_margin", 2).alias("Avg_Margin_Pct"),
        F.concat_ws(" / ", margin_label, volume_label).alias("Quadrant")).orderBy("Product")


@reads("customer_name", "revenue")
def below_mean_median(sales: DataFrame) -> DataFrame:
    """Share of customers whose revenue (B7 figures) is below the B7 mean
    and below the B7 median."""
    return below_mean_median_from(customer_ranking(sales))


def below_mean_median_from(ranked: DataFrame) -> DataFrame:
    agg = ranked.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.count_if(F.col("Total_Order_Value") < F.col("Avg_Order_Value")).alias("Below_Mean"),
        F.count_if(F.col("Total_Order_Value") < F.col("Median_Order_Value")).alias("Below_Median"))
    return agg.select(
        "Customers", "Below_Mean", "Below_Median",
        snap_round(F.col("Below_Mean") / F.col("Customers") * 100, 1).alias("Below_Mean_Pct"),
        snap_round(F.col("Below_Median") / F.col("Customers") * 100, 1).alias("Below_Median_Pct"))


@reads("customer_name", "order_number")
def repeat_purchase(sales: DataFrame) -> DataFrame:
    """Customers with at least two distinct orders, and their share."""
    return repeat_purchase_from(sales.groupBy(F.col("customer_name").alias("Customer")).agg(
        F.countDistinct("order_number").alias("_orders")))


def repeat_purchase_from(customers: DataFrame) -> DataFrame:
    agg = customers.agg(F.count(F.lit(1)).alias("Customers"),
                        F.count_if(F.col("_orders") >= 2).alias("Repeat_Customers"))
    return agg.select("Customers", "Repeat_Customers",
                      snap_round(F.col("Repeat_Customers") / F.col("Customers") * 100, 1)
                      .alias("Repeat_Share_Pct"))


@reads("product_name", "revenue")
def abc_mix(sales: DataFrame, cuts=ABC_CUTS) -> DataFrame:
    """Products and revenue share per ABC class (from B18)."""
    return abc_mix_from(abc_pareto(sales, cuts))


def abc_mix_from(abc: DataFrame) -> DataFrame:
    per = abc.groupBy("ABC_Class").agg(
        F.count(F.lit(1)).alias("Products"),
        F.sum(F.col("Revenue_M").cast("decimal(18,2)")).alias("_rm"))
    total = F.sum("_rm").over(Window.partitionBy())      # bounded: three classes
    return per.select(
        "ABC_Class", "Products", F.col("_rm").cast("double").alias("Revenue_M"),
        snap_round(F.col("_rm").cast("double") / total.cast("double") * 100, 1).alias("Share_Pct"),
    ).orderBy("ABC_Class")
