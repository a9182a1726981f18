"""Customer reports: B7 ranking against mean and median, B10 RFM segments,
B11 lifetime value.

All three are functions of one row per customer (the ``customer`` grain:
``_rev``, ``_orders``, ``_first``, ``_last``); the ``*_from`` forms take that
table as is.  The customer table grows with the data, so nothing here
orders it inside a single task beyond a proven size bound: the rank, both
NTILEs (in shared passes) and the median use the operators of
``revlens.operators.ordered``; mean, median and anchor date are one row.
``COUNT(DISTINCT order)`` per customer is planned by Spark as a two-level
aggregation keyed by (customer, order) first, so a very large customer is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.semantics import (MILLION, THOUSAND, day_diff, first_match,
                                         month_boundaries, safe_div, scale_round,
                                         scale_round_dec, snap_round)
from revlens.operators.ordered import materialize, percentile_values, with_ntiles, with_rank
from revlens.plans.common import reads
from revlens.plans.grains import by_customer


@reads("customer_name", "revenue")
def customer_ranking(sales: DataFrame, approx_median: bool = False,
                     accuracy: int = 10_000) -> DataFrame:
    """Revenue per customer (millions, 1 dp) with the mean (1 dp) and
    median of those rounded values, and the rank (gaps after ties).

    ``approx_median=True`` (opt-in) uses ``percentile_approx`` — one
    aggregation pass with a bounded sketch instead of the exact two-pass
    median; it returns an observed value (no interpolation) within
    ``1/accuracy`` of the exact rank."""
    return customer_ranking_from(
        sales.groupBy(F.col("customer_name").alias("Customer")).agg(F.sum("revenue").alias("_rev")),
        approx_median, accuracy)


def customer_ranking_from(customers: DataFrame, approx_median: bool = False,
                          accuracy: int = 10_000) -> DataFrame:
    per = customers.select("Customer", scale_round_dec("_rev", MILLION, 1).alias("_value"))
    per = materialize(per)          # mean, median and rank all read it
    mean = snap_round(per.agg(F.sum("_value").cast("double") / F.count("_value")).scalar(), 1)
    if approx_median:
        middle = per.agg(F.percentile_approx(F.col("_value").cast("double"), 0.5, accuracy)).scalar()
    else:
        middle = F.lit(percentile_values(per, {"_value": [0.5]})["_value"][0]).cast("double")
    median = snap_round(middle, 2)
    per = with_rank(per, "_value", desc=True, name="rank")
    return per.select(
        "Customer", F.col("_value").cast("double").alias("Total_Order_Value"),
        mean.alias("Avg_Order_Value"), median.alias("Median_Order_Value"),
        F.col("rank").cast("long").alias("rank"),
    ).orderBy(F.desc("Total_Order_Value"), "Customer")


# Recency score bounds (days) and segment rules of the reference.
RECENCY_BOUNDS = (0, 2, 5, 9)       # =b0 -> 5, <=b1 -> 4, <=b2 -> 3, <=b3 -> 2, else 1
SEGMENTS = (
    # (min total, max F score, min F score, max M score, label); first match wins
    (13, None, None, None, "Champion"),
    (11, None, None, None, "Loyal Customer"),
    (4, 2, None, None, "New Customer"),
    (9, None, None, None, "Potential Loyalist"),
    (None, None, 4, 2, "Needs Attention"),
)
OTHER_SEGMENT = "Developing"


def recency_score(recency, bounds=RECENCY_BOUNDS):
    r = F.col(recency) if isinstance(recency, str) else recency
    b0, b1, b2, b3 = bounds
    return first_match([(r == b0, 5), (r <= b1, 4), (r <= b2, 3), (r <= b3, 2)], 1)


def rfm_segment(total, f_score, m_score, rules=SEGMENTS, other=OTHER_SEGMENT):
    conds = []
    for min_total, max_f, min_f, max_m, label in rules:
        cond = F.lit(True)
        if min_total is not None:
            cond = cond & (total >= min_total)
        if max_f is not None:
            cond = cond & (f_score <= max_f)
        if min_f is not None:
            cond = cond & (f_score >= min_f)
        if max_m is not None:
            cond = cond & (m_score <= max_m)
        conds.append((cond, label))
    return first_match(conds, other)


@reads("customer_name", "order_date", "order_number", "revenue")
def rfm_segmentation(sales: DataFrame, recency_bounds=RECENCY_BOUNDS,
                     score_direction: str = "reference") -> DataFrame:
    """Recency / frequency / monetary scores and segment per customer.

    F and M are NTILE(5) over the *descending* values in the reference, so
    score 1 is the most frequent / largest spender while R gives 5 to the
    most recent ('reference', the default); ``score_direction='high_is_best'``
    orders F and M ascending instead.  Ties are broken by customer name."""
    return rfm_segmentation_from(by_customer(sales), recency_bounds, score_direction)


def rfm_segmentation_from(customers: DataFrame, recency_bounds=RECENCY_BOUNDS,
                          score_direction: str = "reference") -> DataFrame:
    if score_direction not in ("reference", "high_is_best"):
        raise ValueError("score_direction must be 'reference' or 'high_is_best'")
    desc = score_direction == "reference"

    base = materialize(customers.select(       # both NTILEs and the anchor read it
        "Customer", "_last", F.col("_orders").alias("Frequency"),
        scale_round_dec("_rev", THOUSAND, 2).alias("_monetary")))
    whole = base.agg(F.count(F.lit(1)).alias("n"), F.max("_last").alias("last")).first()
    scored = with_ntiles(base, 5, {"F_Score": [("Frequency", desc), "Customer"],
                                   "M_Score": [("_monetary", desc), "Customer"]}, rows=whole["n"])
    anchor = F.lit(whole["last"]).cast("date")              # = MAX(order_date) of the table
    scored = scored.withColumn("Recency", day_diff("_last", anchor)) \
        .withColumn("R_Score", recency_score("Recency", recency_bounds))
    total = F.col("R_Score") + F.col("F_Score") + F.col("M_Score")
    cell = F.concat(F.col("R_Score").cast("string"), F.col("F_Score").cast("string"),
                    F.col("M_Score").cast("string"))
    return scored.select(
        "Customer", F.col("Recency").cast("long").alias("Recency"),
        F.col("Frequency").cast("long").alias("Frequency"),
        F.col("_monetary").cast("double").alias("Monetary_000s"),
        F.col("R_Score").cast("long").alias("R_Score"),
        F.col("F_Score").cast("long").alias("F_Score"),
        F.col("M_Score").cast("long").alias("M_Score"),
        cell.alias("RFM_Cell"),
        rfm_segment(total, F.col("F_Score"), F.col("M_Score")).alias("Customer_Segment"),
    ).orderBy("Customer")


def customer_stats(customers: DataFrame) -> DataFrame:
    """Per customer: distinct orders, revenue, mean order value, active months
    (month boundaries crossed) and orders per active month."""
    per = customers.select("Customer", F.col("_orders").alias("Total_Orders"),
                           F.round("_rev", 2).alias("_revenue"), "_first", "_last")
    return per.select(
        "Customer", "Total_Orders", "_revenue",
        snap_round(F.col("_revenue").cast("double") / F.col("Total_Orders"), 2).alias("_aov"),
        month_boundaries("_first", "_last").alias("Active_Months"),
    ).withColumn("_opm", snap_round(safe_div(F.col("Total_Orders").cast("double"),
                                             F.col("Active_Months")), 2))


@reads("customer_name", "order_date", "order_number", "revenue")
def customer_lifetime_value(sales: DataFrame, horizon_months: int = 12) -> DataFrame:
    """Projected CLV = AOV x orders per month x horizon, in thousands.

    Uses the already rounded AOV and rate, as the reference does; a customer
    active within a single month has no rate and no CLV (sorted last)."""
    return customer_lifetime_value_from(by_customer(sales), horizon_months)


def customer_lifetime_value_from(customers: DataFrame, horizon_months: int = 12) -> DataFrame:
    st = customer_stats(customers)
    clv = snap_round(F.col("_aov") * F.col("_opm") * horizon_months / 1000, 1)
    return st.select(
        "Customer", F.col("Total_Orders").cast("long").alias("Total_Orders"),
        scale_round("_revenue", THOUSAND, 1).alias("Total_Revenue_K"),
        snap_round(F.col("_aov") / 1000, 1).alias("Avg_Order_Value_K"),
        F.col("Active_Months").cast("long").alias("Active_Months"),
        F.col("_opm").alias("Orders_Per_Month"),
        clv.alias("Projected_Annual_CLV_K"),
    ).orderBy(F.desc_nulls_last("Projected_Annual_CLV_K"), "Customer")
