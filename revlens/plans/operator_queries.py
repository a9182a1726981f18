"""Operator-level queries over the driver's tables (one per operator family
of the inventory that is not already a report by itself).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame built from
whole tables; those that materialise a step run it when they are called.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.semantics import (THOUSAND, day_diff, month_boundaries, safe_div,
                                         scale_round, scale_round_dec, snap_round)
from revlens.operators.cleaning import preview, promote_header, rename_simultaneous
from revlens.operators.features import round_money
from revlens.operators.joins import (dedupe_first, duplicate_keys, lookup_join,
                                     unmatched_counts)
from revlens.operators.ordered import (materialize, percentiles_cont, with_ntile,
                                       with_range_cumsum, with_rank)
from revlens.operators.quality import (duplicate_rows, null_counts, profile_shape,
                                       schema_summary, validation_summary)
from revlens.plans.orders import order_totals, order_value_bucket
from revlens.plans.enrichment import RENAMES, clean_sales
from revlens.plans.trend import DATA_PIVOT_YEARS
from revlens.session import ensure_checkpoint_dir
from revlens.sources.sheets import load_gated_csv, load_sheets
from revlens.sources.sinks import write_csv
from revlens.sources.tables import (derive_line_measures, read_table, sales_fact,
                                    sheets_from_tables)

STAR_TABLES = ("lineitem", "orders", "customer", "part", "nation", "region")


def output_types(df: DataFrame) -> DataFrame:
    """Final projection: DECIMAL -> DOUBLE, INT -> BIGINT (engine-neutral)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- sources / pipeline -------------------------------------------------------------

def star_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J6 + P1-P7 + F1-F5: the cleaning pipeline over the tables as sheets."""
    fact = clean_sales(sheets_from_tables(spark, sf_dir), budget_year=2000, state_header=None,
                       on_duplicate="error", derive=derive_line_measures,
                       round_money_cols=False)
    return output_types(fact)


def money_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the fact with money columns rounded half-to-even at 2 dp."""
    return output_types(round_money(sales_fact(spark, sf_dir)))


def simultaneous_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the Regions sheet joined, renamed in one projection
    (state_code -> state while state -> state_name)."""
    regions = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("state_code"),
        F.col("n_name").alias("state"), F.col("n_nationkey").cast("double").alias("latitude"),
        F.col("n_regionkey").cast("double").alias("longitude"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    wide = lookup_join(cust, regions, "c_nationkey", "id", on_duplicate="error",
                       drop_right_keys=True, name="Regions").drop("c_nationkey")
    return rename_simultaneous(wide, {c: RENAMES[c] for c in ("state_code", "state", "latitude",
                                                              "longitude")})


def budget_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order year, rows and rows that keep a budget (only the budget year)."""
    fact = sales_fact(spark, sf_dir, columns=("order_date", "budget"))
    return fact.groupBy(F.year("order_date").cast("long").alias("Year")).agg(
        F.count(F.lit(1)).alias("Rows"), F.count("budget").alias("Budget_Rows"),
        F.sum("budget").cast("double").alias("Budget_Total"))


def bucketize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's total and its value bucket."""
    totals = order_totals(sales_fact(spark, sf_dir, columns=("order_number", "revenue")))
    return totals.select("order_number", F.col("total_purchase").cast("double").alias("Order_Total"),
                         order_value_bucket("total_purchase").alias("Order_Value_Category"))


# --- joins ----------------------------------------------------------------------------

def fanout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key uniqueness of every lookup (and of two keys that are *not* unique)."""
    checks = [("orders", "orders", ["o_orderkey"]), ("customer", "customer", ["c_custkey"]),
              ("part", "part", ["p_partkey"]), ("nation", "nation", ["n_nationkey"]),
              ("region", "region", ["r_regionkey"]), ("part_by_brand", "part", ["p_brand"]),
              ("lineitem_line", "lineitem", ["l_orderkey", "l_linenumber"])]
    parts = []
    for name, table, keys in checks:
        dim = read_table(spark, sf_dir, table)
        rows = dim.agg(F.count(F.lit(1))).scalar()           # scalar subquery
        dups = duplicate_keys(dim, keys).agg(
            F.count(F.lit(1)).alias("Duplicated_Keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("Excess_Rows"))
        parts.append(dups.select(F.lit(name).alias("Lookup"), rows.alias("Rows"),
                                 "Duplicated_Keys", "Excess_Rows"))
    return reduce(DataFrame.unionByName, parts)


def unmatched_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: fact rows without a lookup match, per join of the star."""
    t = {n: read_table(spark, sf_dir, n) for n in STAR_TABLES}
    parts = [
        unmatched_counts(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey", "orders"),
        unmatched_counts(t["lineitem"], t["part"], "l_partkey", "p_partkey", "part"),
        unmatched_counts(t["orders"], t["customer"], "o_custkey", "c_custkey", "customer"),
        unmatched_counts(t["customer"], t["nation"], "c_nationkey", "n_nationkey", "nation"),
        unmatched_counts(t["nation"], t["region"], "n_regionkey", "r_regionkey", "region"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- data quality -----------------------------------------------------------------------

def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: rows and columns of every table of the star."""
    return profile_shape({n: read_table(spark, sf_dir, n) for n in STAR_TABLES})


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: NULL count of every fact column."""
    return null_counts(sales_fact(spark, sf_dir))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: excess full-row copies per table (plus the lineitem key projection)."""
    frames = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part")}
    frames["lineitem_keys"] = frames["lineitem"].select("l_orderkey", "l_linenumber")
    return reduce(DataFrame.unionByName,
                  [duplicate_rows(df).select(F.lit(n).alias("dataset"), "duplicate_rows")
                   for n, df in frames.items()])


def schema_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: column, type and non-null count of the fact."""
    return schema_summary(sales_fact(spark, sf_dir))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: violations of every load-gate rule over the fact."""
    return validation_summary(sales_fact(spark, sf_dir))


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 over a fact with derived violations: missing order numbers, over-long
    names and quantities that are no numbers."""
    fact = sales_fact(spark, sf_dir)
    order = F.col("order_number").cast("long")
    broken = fact.withColumns({
        "order_number": F.when(order % 7 != 0, F.col("order_number")),
        "customer_name": F.when(order % 11 == 0, F.repeat("customer_name", 4))
        .otherwise(F.col("customer_name")),
        "quantity": F.when(order % 13 == 0, F.lit("12x")).otherwise(F.col("quantity").cast("string")),
    })
    return validation_summary(broken)


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6 with derived orphans: part keys that no part has, and missing ones."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(
        F.col("l_orderkey") % 5 == 0, -F.col("l_partkey")).when(
        F.col("l_orderkey") % 5 != 1, F.col("l_partkey")).alias("l_partkey"))
    return unmatched_counts(lines, read_table(spark, sf_dir, "part"), "l_partkey", "p_partkey",
                            "part")


def dedupe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part per brand, the cheapest; prices of some brands are missing."""
    part = read_table(spark, sf_dir, "part").select(
        "p_brand", "p_partkey", F.when(F.col("p_brand").substr(-1, 1) != "3",
                                       F.col("p_retailprice")).alias("price"))
    return output_types(dedupe_first(part, "p_brand", "price"))


def promoted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The State Regions sheet with its header as a data row, in another
    case and with blanks, made a header again."""
    regions = sheets_from_tables(spark, sf_dir)["State Regions"].toDF("Column1", "Column2")
    header = spark.range(1).select(F.lit(" STATE code").alias("Column1"),
                                   F.lit("Region ").alias("Column2"))
    return promote_header(regions.unionByName(header), ("State Code", "Region")) \
        .toDF("State_Code", "Region")


def _exported(spark: SparkSession, df: DataFrame, name: str) -> str:
    """``df`` as a CSV export in the session's shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4()}/{name}"
    write_csv(df, path)
    return path


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact exported as CSV and loaded again through the gate."""
    accepted, _ = load_gated_csv(spark, _exported(spark, sales_fact(spark, sf_dir), "sales"))
    return output_types(accepted)


def sheet_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sheets exported as CSV and loaded as a catalogue; what each
    typed column holds.  Order numbers are padded, and the padding must
    survive."""
    sheets = sheets_from_tables(spark, sf_dir)
    sheets["Sales Orders"] = sheets["Sales Orders"].withColumn(
        "OrderNumber", F.lpad("OrderNumber", 12, "0"))
    loaded = load_sheets(spark, {n: _exported(spark, df, n.replace(" ", "_"))
                                 for n, df in sheets.items()}, fmt="csv", required=list(sheets))
    parts = []
    for name, df in loaded.items():
        for c in df.columns:
            value = F.col(f"`{c}`")
            parts.append(df.agg(
                F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"),
                F.count_distinct(value).alias("n_distinct"), F.min(value).cast("string").alias("low"),
                F.max(value).cast("string").alias("high")).select(
                F.lit(name).alias("sheet"), F.lit(c).alias("column"), "*"))
    return reduce(DataFrame.unionByName, parts)


# --- functions / aggregates / windows -------------------------------------------------

def month_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per customer first and last order, days and month boundaries."""
    fact = sales_fact(spark, sf_dir, columns=("customer_name", "order_date"))
    per = fact.groupBy(F.col("customer_name").alias("Customer")).agg(
        F.min("order_date").alias("First_Order"), F.max("order_date").alias("Last_Order"))
    return per.select("Customer", "First_Order", "Last_Order",
                      day_diff("First_Order", "Last_Order").cast("long").alias("Active_Days"),
                      month_boundaries("First_Order", "Last_Order").cast("long")
                      .alias("Active_Months"))


def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per cost dollar and per order for each state (zero-guarded)."""
    fact = sales_fact(spark, sf_dir, columns=("state_name", "order_number", "revenue",
                                              "total_cost"))
    per = fact.groupBy(F.col("state_name").alias("State")).agg(
        F.sum("revenue").alias("_rev"), F.sum("total_cost").alias("_cost"),
        F.countDistinct("order_number").alias("_orders"))
    return per.select(
        "State",
        snap_round(safe_div(F.col("_rev").cast("double"), F.col("_cost").cast("double")), 4)
        .alias("Revenue_Per_Cost"),
        snap_round(safe_div(F.col("_rev").cast("double"), F.col("_orders")), 2)
        .alias("Revenue_Per_Order"))


def pivot_api(spark: SparkSession, sf_dir: str, years=DATA_PIVOT_YEARS) -> DataFrame:
    """A8 with ``GroupedData.pivot`` over an explicit year list (same result as B16)."""
    fact = sales_fact(spark, sf_dir, columns=("month_no", "order_month_name", "order_date",
                                              "revenue"))
    keyed = fact.select(F.col("month_no").alias("Month_Num"),
                        F.col("order_month_name").alias("Month"),
                        F.year("order_date").alias("_year"), "revenue")
    # the fact is read once: a row per month and year feeds grid and totals
    per = materialize(keyed.groupBy("Month_Num", "Month", "_year").agg(
        F.sum("revenue").alias("_rev")))
    grid = per.groupBy("Month_Num", "Month").pivot("_year", list(years)).agg(
        F.sum("_rev").alias("_rev"))
    totals = per.groupBy(F.col("Month_Num").alias("_m")).agg(F.sum("_rev").alias("_all"))
    # a month a row; rows without a date are a group of their own
    joined = grid.join(totals, grid["Month_Num"].eqNullSafe(totals["_m"])).drop("_m")
    return joined.select(
        F.col("Month_Num").cast("long").alias("Month_Num"), "Month",
        *[scale_round(F.coalesce(F.col(str(y)), F.lit(0)), "0.000001", 2).alias(f"{y}_M")
          for y in years],
        scale_round("_all", "0.000001", 2).alias("All_Years_Total_M"))


def order_value_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact continuous quartiles of the order totals (one row)."""
    totals = materialize(order_totals(sales_fact(spark, sf_dir,
                                                 columns=("order_number", "revenue"))))
    names = ["P25_Order_Value", "Median_Order_Value", "P75_Order_Value"]
    quartiles = percentiles_cont(totals, "total_purchase", (0.25, 0.5, 0.75), names)
    orders = totals.agg(F.count(F.lit(1))).scalar()
    return quartiles.select(orders.alias("Orders"), *[snap_round(n, 2).alias(n) for n in names])


def _customer_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = sales_fact(spark, sf_dir, columns=("customer_name", "revenue"))
    return fact.groupBy(F.col("customer_name").alias("Customer")).agg(
        scale_round_dec(F.sum("revenue"), THOUSAND, 2).alias("_rk"))


def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by revenue (distributed RANK, gaps after ties)."""
    per = with_rank(materialize(_customer_revenue(spark, sf_dir)), "_rk", True, "Revenue_Rank")
    return per.select("Customer", F.col("_rk").cast("double").alias("Revenue_K"),
                      F.col("Revenue_Rank").cast("long").alias("Revenue_Rank"))


def partitioned_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by revenue inside their channel (distributed
    RANK ... PARTITION BY; a channel may hold a large share of customers)."""
    fact = sales_fact(spark, sf_dir, columns=("customer_name", "channel", "revenue"))
    per = fact.groupBy(F.col("channel").alias("Channel"),
                       F.col("customer_name").alias("Customer")).agg(
        scale_round_dec(F.sum("revenue"), THOUSAND, 2).alias("_rk"))
    per = with_rank(materialize(per), "_rk", True, "Rank_In_Channel",
                    partition_by="Channel")
    return per.select("Channel", "Customer", F.col("_rk").cast("double").alias("Revenue_K"),
                      F.col("Rank_In_Channel").cast("long").alias("Rank_In_Channel"))


def global_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value decile of every order (distributed NTILE(10); ties by order number)."""
    totals = order_totals(sales_fact(spark, sf_dir, columns=("order_number", "revenue")))
    dec = with_ntile(materialize(totals), 10, [("total_purchase", True), "order_number"],
                     "Value_Decile")
    return dec.select("order_number", F.col("total_purchase").cast("double").alias("Order_Total"),
                      F.col("Value_Decile").cast("long").alias("Value_Decile"))


def range_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running revenue over customers by descending revenue, RANGE frame
    (tied customers share one running total)."""
    per = with_range_cumsum(materialize(_customer_revenue(spark, sf_dir)), "_rk", "_rk", True,
                            "_cum")
    return per.select("Customer", F.col("_rk").cast("double").alias("Revenue_K"),
                      F.col("_cum").cast("double").alias("Cumulative_K"))


def top_customers(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """O2: the ``n`` customers with the largest revenue (ties by name)."""
    per = _customer_revenue(spark, sf_dir)
    return per.select("Customer", F.col("_rk").cast("double").alias("Revenue_K")) \
        .orderBy(F.desc("Revenue_K"), "Customer").limit(n)


def fact_preview(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """O3: ``SELECT TOP 100 * FROM Sales`` with a deterministic order."""
    return output_types(preview(sales_fact(spark, sf_dir), n))
