"""Time reports: B1 monthly trend + MoM, B2 seasonality, B13 running and
rolling averages, B16 month x year pivot.

All four are functions of the monthly revenue table (``Year``, ``Month``,
``_rev``): one partial + final hash aggregation of the fact.  The windows
that follow run over that month table, whose size is bounded by the
calendar (12 rows per year), never over fact rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.semantics import (MILLION, month_name_of, pct_change, pct_label,
                                         scale_round, scale_round_dec, snap_round)
from revlens.plans.common import reads
from revlens.plans.grains import by_month


def _month_name(month_col: str = "Month"):
    """Full English month name of a month number."""
    return month_name_of(month_col)


def _months(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("Year", "Month").agg(F.sum("_rev").alias("_rev"))


@reads("order_date", "revenue")
def monthly_trend(sales: DataFrame, digits: int = 1) -> DataFrame:
    """B1: revenue per (year, month) in millions and the change against the
    previous *row* (a missing month is skipped, not zero-filled)."""
    return monthly_trend_from(by_month(sales), digits)


def monthly_trend_from(monthly: DataFrame, digits: int = 1) -> DataFrame:
    m = _months(monthly).withColumn("Current_Month_Revenue",
                                    scale_round("_rev", MILLION, digits))
    calendar = Window.orderBy("Year", "Month")          # bounded: one row per month
    m = m.withColumn("Previous_Month_Revenue", F.lag("Current_Month_Revenue").over(calendar))
    diff = snap_round(pct_change("Current_Month_Revenue", "Previous_Month_Revenue"), 2)
    return m.select(
        F.col("Year").cast("long").alias("Year"), F.col("Month").cast("long").alias("Month"),
        "Current_Month_Revenue", "Previous_Month_Revenue",
        pct_label(diff, "%").alias("Difference")).orderBy("Year", "Month")


@reads("order_date", "revenue")
def seasonality(sales: DataFrame) -> DataFrame:
    """B2: revenue per calendar month name over all years, largest first."""
    return seasonality_from(by_month(sales))


def seasonality_from(monthly: DataFrame) -> DataFrame:
    return (monthly.groupBy(_month_name().alias("Month"))
            .agg(scale_round(F.sum("_rev"), MILLION, 2).alias("Total_Revenue"))
            .orderBy(F.desc("Total_Revenue"), "Month"))


@reads("order_date", "revenue")
def rolling_averages(sales: DataFrame, window: int = 3) -> DataFrame:
    """Monthly revenue (millions, 2 dp), the running mean restarting each
    year and the rolling mean of the last ``window`` rows across years.

    Means are taken over the *rounded* monthly values, as the reference does,
    computed exactly in DECIMAL and snapped to 2 dp."""
    return rolling_averages_from(by_month(sales), window)


def rolling_averages_from(monthly: DataFrame, window: int = 3) -> DataFrame:
    m = _months(monthly).withColumn("_rm", scale_round_dec("_rev", MILLION, 2))
    running = Window.partitionBy("Year").orderBy("Month").rowsBetween(Window.unboundedPreceding, 0)
    rolling = Window.orderBy("Year", "Month").rowsBetween(-(window - 1), 0)

    def mean_over(w):
        return snap_round(F.sum("_rm").over(w).cast("double") / F.count("_rm").over(w), 2)

    return m.select(
        F.col("Year").cast("long").alias("Year"), F.col("Month").cast("long").alias("Month"),
        _month_name().alias("Month_Name"), F.col("_rm").cast("double").alias("Revenue_M"),
        mean_over(running).alias("Running_Avg"),
        mean_over(rolling).alias("Rolling_3M_Avg_M")).orderBy("Year", "Month")


# The reference pivots the years 2014-2017; the test data spans 1995-2001.
REFERENCE_PIVOT_YEARS = (2014, 2015, 2016, 2017)
DATA_PIVOT_YEARS = tuple(range(1995, 2002))


@reads("order_date", "revenue")
def month_year_pivot(sales: DataFrame, years: Sequence[int] = REFERENCE_PIVOT_YEARS) -> DataFrame:
    """Month x year revenue grid (millions, 2 dp).

    Conditional sums over an explicit year list (one pass, no extra job to
    discover pivot values); an absent year is 0.0, and the total covers all
    years, listed or not."""
    return month_year_pivot_from(by_month(sales), years)


def month_year_pivot_from(monthly: DataFrame,
                          years: Sequence[int] = REFERENCE_PIVOT_YEARS) -> DataFrame:
    cells = [scale_round(F.sum(F.when(F.col("Year") == y, F.col("_rev")).otherwise(F.lit(0))),
                         MILLION, 2).alias(f"{y}_M") for y in years]
    return (monthly.groupBy(F.col("Month").alias("Month_Num"))
            .agg(*cells, scale_round(F.sum("_rev"), MILLION, 2).alias("All_Years_Total_M"))
            .select(F.col("Month_Num").cast("long").alias("Month_Num"),
                    _month_name("Month_Num").alias("Month"),
                    *[f"{y}_M" for y in years], "All_Years_Total_M")
            .orderBy("Month_Num"))
