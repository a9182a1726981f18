"""F1-F6 — derived measures of the sales fact.

F1 total_cost = quantity * unit cost, F2 profit = revenue - total_cost,
F3 margin % (zero revenue -> NULL, flagged by the Q5 gate), F4 month name,
F5 month number; F6 is the optional 2-dp half-even rounding of the money
columns, applied last so that F1-F3 use unrounded inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.semantics import half_even, month_name

# The money columns rounded by the export step.
MONEY_COLUMNS = ["unit_price", "revenue", "cost", "budget", "total_cost", "profit",
                 "profit_margin_pct"]


def margin_pct(profit, revenue):
    """``profit / revenue * 100`` in DOUBLE, snapped to 2 dp as DECIMAL(9,2)."""
    ratio = F.try_divide(F.col(profit).cast("double"),
                         F.nullif(F.col(revenue).cast("double"), F.lit(0.0))) * 100
    return F.round(ratio.cast("decimal(28,10)"), 2).cast("decimal(9,2)")


def add_features(df: DataFrame, *, quantity="quantity", cost="cost", revenue="revenue",
                 order_date="order_date", month_no_name="month_no") -> DataFrame:
    """F1-F5 on a frame that has quantity, unit cost, revenue and order date."""
    total_cost = (F.col(quantity) * F.col(cost)).cast("decimal(18,4)")
    df = df.withColumn("total_cost", total_cost)
    df = df.withColumn("profit", (F.col(revenue) - F.col("total_cost")).cast("decimal(18,4)"))
    df = df.withColumn("profit_margin_pct", margin_pct("profit", revenue))
    if order_date is None:          # calendar features need the order date
        return df
    return calendar_features(df, order_date, month_no_name)


def calendar_features(df: DataFrame, order_date="order_date", month_no_name="month_no") -> DataFrame:
    """full month name and month number of the order date."""
    return df.withColumns({
        "order_month_name": month_name(order_date),
        month_no_name: F.month(order_date),
    })


def round_money(df: DataFrame, columns=MONEY_COLUMNS, digits: int = 2) -> DataFrame:
    """half-to-even rounding (pandas ``round``) of the money columns."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: half_even(c, digits).cast(df.schema[c].dataType) for c in present})
