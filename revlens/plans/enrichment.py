"""The cleaning / enrichment pipeline: six raw sheets -> the typed sales fact.

Steps (reference order): promote the State Regions header (P1) and fold its
names (P2); five lookup joins with a fan-out guard (J1-J6); drop the right
keys (P4); lower-case names (P3); keep 15 columns (P5); rename them all at
once (P6); keep the budget only in the budget year (P7); derive total cost,
profit, margin, month name and number (F1-F5); round money half-even (F6).

Everything is one lazy plan: Spark joins the lookups on executors (broadcast
when small, sort-merge otherwise) and prunes unused sheet columns at the scan.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.cleaning import (drop_columns, mask_outside_year, normalize_columns,
                                        promote_header, rename_simultaneous, select_strict)
from revlens.operators.features import add_features, round_money
from revlens.operators.joins import JoinWatch, lookup_join
from revlens.schema import conform

# The reference's join keys, pruned keys, kept columns and renames.
JOINS = (
    # (sheet, left key, right key)
    ("Customers", "Customer Name Index", "Customer Index"),
    ("Products", "Product Description Index", "Index"),
    ("Regions", "Delivery Region Index", "id"),
    ("State Regions", "state_code", "state code"),
)
DROPPED_KEYS = ("Customer Index", "Index", "id", "state code")
KEEP_COLUMNS = ("ordernumber", "orderdate", "customer names", "channel", "product name",
                "order quantity", "unit price", "line total", "total unit cost", "state_code",
                "state", "region", "latitude", "longitude")
RENAMES = {
    "ordernumber": "order_number",
    "orderdate": "order_date",
    "customer names": "customer_name",
    "product name": "product_name",
    "order quantity": "quantity",
    "unit price": "unit_price",
    "line total": "revenue",
    "total unit cost": "cost",
    "state_code": "state",
    "state": "state_name",
    "region": "us_region",
    "latitude": "lat",
    "longitude": "lon",
}
STATE_REGION_HEADER = ("State Code", "Region")


def clean_sales(sheets: Mapping[str, DataFrame], *, budget_year: int = 2017,
                budget_sheet: str | None = None, state_header=STATE_REGION_HEADER,
                on_duplicate: str = "error", null_safe: bool = False,
                derive: Callable[[DataFrame], DataFrame] | None = None,
                round_money_cols: bool = True, watch: JoinWatch | None = None) -> DataFrame:
    """Run the pipeline over ``{sheet name: DataFrame}``.

    ``budget_sheet`` defaults to ``'<budget_year> Budgets'``; its value
    column is ``'<budget_year> Budgets'`` too.  ``state_header`` names the
    header values found in the first data row of State Regions (``None`` when
    the sheet already has a proper header).  ``derive`` may add source
    columns the order sheet lacks, after the joins and before the keep-list.
    The planner and AQE choose how each lookup is joined.  ``watch`` counts
    what each join does, and with ``on_duplicate='watch'`` the fan-out guard
    needs no job of its own.
    """
    budget_sheet = budget_sheet or f"{budget_year} Budgets"
    state_reg = sheets["State Regions"]
    if state_header is not None:
        state_reg = promote_header(state_reg, header_values=state_header)
    state_reg = normalize_columns(state_reg, strip=True).select("state code", "region")
    lookups = {"Customers": sheets["Customers"], "Products": sheets["Products"],
               "Regions": sheets["Regions"], "State Regions": state_reg}

    df = sheets["Sales Orders"]
    for sheet, left, right in JOINS:
        df = lookup_join(df, lookups[sheet], left, right, how="left", on_duplicate=on_duplicate,
                         null_safe=null_safe, name=sheet, watch=watch)
    df = lookup_join(df, sheets[budget_sheet], "Product Name", how="left",
                     on_duplicate=on_duplicate, null_safe=null_safe, name=budget_sheet, watch=watch)
    df = drop_columns(df, DROPPED_KEYS)
    df = normalize_columns(df, strip=False)
    if derive is not None:
        df = derive(df)
    budget_col = f"{budget_year} budgets"
    df = select_strict(df, KEEP_COLUMNS + (budget_col,))
    df = rename_simultaneous(df, {**RENAMES, budget_col: "budget"})
    df = df.withColumns({                       # exact types before the arithmetic
        "order_date": F.to_date("order_date"),
        "quantity": F.col("quantity").cast("int"),
        "unit_price": F.col("unit_price").cast("decimal(18,2)"),
        "revenue": F.col("revenue").cast("decimal(18,2)"),
        "cost": F.col("cost").cast("decimal(18,4)"),
        "budget": F.col("budget").cast("decimal(18,2)"),
    })
    df = mask_outside_year(df, "budget", "order_date", budget_year)
    df = conform(add_features(df))
    return round_money(df) if round_money_cols else df
