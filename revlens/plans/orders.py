"""B6 — order-value distribution.

Order totals (one row per order) are bucketed, then counted per bucket; the
share of each bucket is taken over the bucket table (six rows at most).
A hot order key is absorbed by partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.semantics import pct_label, range_bucket, snap_round
from revlens.plans.common import reads
from revlens.plans.grains import by_order

# Order-value buckets, closed-open, tested in this order; the
# last label carries a trailing blank in the reference.
ORDER_VALUE_EDGES = (
    (100000, 200000, "100k to 200k"),
    (200000, 400000, "200k to 400k"),
    (400000, 600000, "400k to 600k"),
    (600000, 700000, "600k to 700k"),
)
ORDER_VALUE_BELOW = (100000, "Below 100k")
ORDER_VALUE_ABOVE = "Above 700k "


def order_value_bucket(total_col) -> "F.Column":
    return range_bucket(total_col, ORDER_VALUE_EDGES, ORDER_VALUE_BELOW, ORDER_VALUE_ABOVE)


order_totals = by_order      # one row per order: its total rounded to 2 dp (exact)


@reads("order_number", "revenue")
def order_value_distribution(sales: DataFrame) -> DataFrame:
    """Orders per value bucket and their share of all orders (1 dp)."""
    return order_value_distribution_from(by_order(sales))


def order_value_distribution_from(orders: DataFrame) -> DataFrame:
    """B6 from one row per order (``order_number``, ``total_purchase``)."""
    buckets = (orders
               .groupBy(order_value_bucket("total_purchase").alias("Order_Value_Category"))
               .agg(F.count(F.lit(1)).alias("Total_orders")))
    all_buckets = Window.partitionBy()                  # bounded: at most six buckets
    share = snap_round(F.col("Total_orders").cast("double")
                       / F.sum("Total_orders").over(all_buckets) * 100, 1)
    return buckets.select("Order_Value_Category", "Total_orders",
                          pct_label(share, " %").alias("Contribution_To_TotalOrders")) \
        .orderBy(F.desc("Total_orders"), "Order_Value_Category")
