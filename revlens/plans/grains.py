"""Grain aggregates: every report is a function of one of these.

A grain is one partial + final hash aggregation of the fact to a key that is
much smaller than the fact (a month, a product and year, a customer, ...).
The measures are exact (DECIMAL sums and counts), so any coarser figure
— a product total over years, a channel total over products, a mean margin
as sum / count — can be derived from the grain without touching the fact
again.  A single report computes its own grain from the fact.

For the whole catalogue the grains form a lattice: two bases, one row per
order and one row per product, channel and year, are aggregated from the fact,
and every grain rolls up one of them.  The bases keep the fact's column names
for what they sum, so a grain is the same function of a base and of the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fact columns each grain reads
GRAIN_COLUMNS = {
    "month": ("order_date", "revenue"),
    "product_year": ("product_name", "order_date", "revenue", "total_cost",
                     "profit_margin_pct"),
    "customer": ("customer_name", "order_number", "order_date", "revenue"),
    "channel_product": ("channel", "product_name", "revenue", "profit", "profit_margin_pct"),
    "state_region": ("state_name", "us_region", "revenue", "profit", "profit_margin_pct"),
    "order": ("order_number", "revenue"),
}


def _margin_measures(df: DataFrame):
    if "_margin_n" in df.columns:                       # a base: summed before
        return [F.sum("_margin_sum").alias("_margin_sum"), F.sum("_margin_n").alias("_margin_n")]
    return [F.sum("profit_margin_pct").alias("_margin_sum"),
            F.count("profit_margin_pct").alias("_margin_n")]


def order_base(sales: DataFrame) -> DataFrame:
    """One row per order (and its customer, place and date).  An order number
    that the fact uses with several of these has a row for each."""
    return sales.groupBy("order_number", "order_date", "customer_name", "state_name", "us_region") \
        .agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
             *_margin_measures(sales))


def product_base(sales: DataFrame) -> DataFrame:
    """One row per product, channel and year (its first day as the date)."""
    return sales.groupBy("product_name", "channel",
                         F.trunc("order_date", "year").alias("order_date")) \
        .agg(F.sum("revenue").alias("revenue"), F.sum("total_cost").alias("total_cost"),
             F.sum("profit").alias("profit"), *_margin_measures(sales))


def by_month(sales: DataFrame) -> DataFrame:
    """(Year, Month) -> revenue."""
    return sales.groupBy(F.year("order_date").alias("Year"), F.month("order_date").alias("Month")) \
        .agg(F.sum("revenue").alias("_rev"))


def by_product_year(sales: DataFrame) -> DataFrame:
    """(Product, Year) -> revenue, total cost, margin sum and count."""
    return sales.groupBy(F.col("product_name").alias("Product"),
                         F.year("order_date").alias("Year")).agg(
        F.sum("revenue").alias("_rev"), F.sum("total_cost").alias("_cost"), *_margin_measures(sales))


def by_customer(sales: DataFrame) -> DataFrame:
    """Customer -> revenue, distinct orders, first and last order date.

    ``COUNT(DISTINCT order)`` is planned as a (customer, order) aggregation
    first, so one very large customer is spread over many tasks."""
    return sales.groupBy(F.col("customer_name").alias("Customer")).agg(
        F.sum("revenue").alias("_rev"), F.countDistinct("order_number").alias("_orders"),
        F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))


def by_channel_product(sales: DataFrame) -> DataFrame:
    """(Channel, Product) -> revenue, profit, margin sum and count."""
    return sales.groupBy(F.col("channel").alias("Channel"),
                         F.col("product_name").alias("Product")).agg(
        F.sum("revenue").alias("_rev"), F.sum("profit").alias("_profit"), *_margin_measures(sales))


def by_state_region(sales: DataFrame) -> DataFrame:
    """(state name, region) -> revenue, profit, margin sum and count."""
    return sales.groupBy("state_name", "us_region").agg(
        F.sum("revenue").alias("_rev"), F.sum("profit").alias("_profit"), *_margin_measures(sales))


def by_order(sales: DataFrame) -> DataFrame:
    """Order -> total rounded to 2 dp (exact)."""
    return sales.groupBy("order_number").agg(F.round(F.sum("revenue"), 2).alias("total_purchase"))


GRAINS = {
    "month": by_month,
    "product_year": by_product_year,
    "customer": by_customer,
    "channel_product": by_channel_product,
    "state_region": by_state_region,
    "order": by_order,
}


# the base that each grain rolls up
BASES = {
    order_base: ("month", "customer", "state_region", "order"),
    product_base: ("product_year", "channel_product"),
}


def margin_mean(sum_col: str = "_margin_sum", n_col: str = "_margin_n"):
    """Unweighted mean row margin from summed grain measures (exact sum / count)."""
    return F.sum(sum_col).cast("double") / F.sum(n_col)
