"""Geography reports: B8 revenue by state and region, B15 margin by state.

Both are functions of per-(state, region) measures (the ``state_region``
grain).  The state and region totals of B8 are aggregations of that table
joined back (rewrite of the reference's DISTINCT + ``SUM() OVER (PARTITION
BY ...)`` over raw rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.semantics import MILLION, scale_round, snap_round
from revlens.operators.ordered import materialize, with_rank
from revlens.plans.common import reads
from revlens.plans.grains import by_state_region, margin_mean


@reads("state_name", "us_region", "revenue")
def state_region_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per state name and per region (millions, 1 dp).  A state
    present in two regions yields two rows with the same state total."""
    return state_region_revenue_from(
        sales.groupBy("state_name", "us_region").agg(F.sum("revenue").alias("_rev")))


def state_region_revenue_from(measures: DataFrame) -> DataFrame:
    # totals per state and per region are aggregations joined back (partial
    # aggregation; a region holding most states is split by AQE's skew join)
    per = materialize(measures.groupBy("state_name", "us_region").agg(F.sum("_rev").alias("_rev")))
    states = per.groupBy(F.col("state_name").alias("_s")).agg(F.sum("_rev").alias("_state_rev"))
    regions = per.groupBy(F.col("us_region").alias("_r")).agg(F.sum("_rev").alias("_region_rev"))
    joined = (per.join(states, per["state_name"].eqNullSafe(states["_s"]), "left")
              .join(regions, per["us_region"].eqNullSafe(regions["_r"]), "left"))
    return joined.select(
        F.col("state_name").alias("States"),
        scale_round("_state_rev", MILLION, 1).alias("Total_State_Revenue"),
        F.col("us_region").alias("Region"),
        scale_round("_region_rev", MILLION, 1).alias("Total_Region_Revenue"),
    ).orderBy(F.desc("Total_State_Revenue"), "States", "Region")   # rows unique per (state, region)


@reads("state_name", "us_region", "revenue", "profit", "profit_margin_pct")
def state_margin(sales: DataFrame) -> DataFrame:
    """Revenue, profit and mean margin per (state, region), ranked on
    the unrounded mean margin."""
    return state_margin_from(by_state_region(sales))


def state_margin_from(measures: DataFrame) -> DataFrame:
    per = measures.groupBy(F.col("state_name").alias("State"),
                           F.col("us_region").alias("Region")).agg(
        F.sum("_rev").alias("_rev"), F.sum("_profit").alias("_profit"),
        margin_mean().alias("_margin"))
    per = with_rank(materialize(per), "_margin", desc=True, name="Margin_Rank")
    return per.select(
        "State", "Region",
        scale_round("_rev", MILLION, 2).alias("Revenue_M"),
        scale_round("_profit", MILLION, 2).alias("Profit_M"),
        snap_round("_margin", 2).alias("Avg_Margin_Pct"),
        F.col("Margin_Rank").cast("long").alias("Margin_Rank"),
    ).orderBy(F.desc("Avg_Margin_Pct"), "Margin_Rank", "State")
