"""The driver's TPC-H-style tables as a sales star, and the sales fact built
from them.

Mapping (one row per lineitem):

  order_number  <- orders.o_orderkey          customer_name <- customer.c_name
  order_date    <- orders.o_orderdate (DATE)  channel       <- customer.c_mktsegment
  product_name  <- part.p_brand               quantity      <- lineitem.l_quantity
  unit_price    <- part.p_retailprice         revenue        = quantity * unit_price
  cost (unit)    = unit_price * (0.55 + l_discount + l_tax) rounded to 2 dp
  state / state_name / us_region <- customer's nation key / name / region
  lat / lon     <- nation key / region key (placeholders, passed through)
  budget         = 1000 * sum of the brand's list prices, kept in one year

Plan shape: orders are enriched with customers first (orders are 4x smaller
than lineitem, customers carry the geography), then lineitem is joined to the
enriched orders on the order key and to the part lookup on the part key.
Nation and region are broadcast behind a row-count check; the large lookups
are left to the planner (sort-merge, or AQE's runtime broadcast / skew split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.cleaning import mask_outside_year
from revlens.operators.features import add_features, calendar_features, round_money
from revlens.operators.joins import lookup_join
from revlens.schema import SALES_COLUMNS, conform

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# Fixed values of the test-data mapping.
BUDGET_YEAR = 2000          # the reference's budget year is 2017; this data spans 1995-2001
BUDGET_MULTIPLIER = 1000
COST_BASE = "0.55"          # unit cost factor = 0.55 + discount + tax


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation + region: key, state code, state name, region name, lat, lon."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    geo = lookup_join(nation, region, "n_regionkey", "r_regionkey", on_duplicate="trust",
                      name="region")
    return geo.select(
        F.col("n_nationkey").alias("geo_key"),
        F.col("n_nationkey").cast("string").alias("state"),
        F.col("n_name").alias("state_name"),
        F.col("r_name").alias("us_region"),
        F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("lon"))


def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> (part key, product name, unit price, product budget)."""
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("product_name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"))
    budgets = part.groupBy("product_name").agg(
        (F.sum("unit_price") * BUDGET_MULTIPLIER).cast("decimal(18,2)").alias("budget"))
    # one row per product name; the runtime size decides how it is joined
    return lookup_join(part, budgets, "product_name", on_duplicate="trust", name="budgets")


def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (key, name, channel, geography)."""
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("channel"), "c_nationkey")
    return lookup_join(cust, geography(spark, sf_dir), "c_nationkey", "geo_key", on_duplicate="trust",
                       drop_right_keys=True, name="regions")


# Which lookups each fact column needs (all lookups are left joins on unique
# keys, so a lookup whose columns are not read can be left out of the plan).
_NEEDS_ORDERS = {"order_date", "customer_name", "channel", "state", "state_name", "us_region",
                 "lat", "lon", "budget", "order_month_name", "month_no"}
_NEEDS_CUSTOMERS = {"customer_name", "channel", "state", "state_name", "us_region", "lat", "lon"}
_NEEDS_PRODUCTS = {"product_name", "unit_price", "revenue", "cost", "budget", "total_cost",
                   "profit", "profit_margin_pct"}


def sales_fact(spark: SparkSession, sf_dir: str, *, budget_year: int = BUDGET_YEAR,
               round_money_cols: bool = False, columns=None) -> DataFrame:
    """The sales fact (schema ``revlens.schema.SALES_SCHEMA``), lazily.

    ``columns`` restricts the fact to the columns a report reads; lookups
    that contribute none of them are not joined at all (Catalyst cannot drop
    an outer join by itself: it does not know the lookup keys are unique).
    The tables are listed anew at every call, so rows added since are seen."""
    wanted = tuple(SALES_COLUMNS) if columns is None else tuple(
        c for c in SALES_COLUMNS if c in set(columns))
    return _build_fact(spark, sf_dir, budget_year, round_money_cols, set(wanted))


def _build_fact(spark, sf_dir, budget_year, round_money_cols, wanted) -> DataFrame:
    li_cols = ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"]
    fact = read_table(spark, sf_dir, "lineitem").select(*li_cols)
    if wanted & _NEEDS_ORDERS:
        orders = read_table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
        if wanted & _NEEDS_CUSTOMERS:
            orders = lookup_join(orders, customer_lookup(spark, sf_dir), "o_custkey", "c_custkey",
                                 on_duplicate="trust", name="customers")
        fact = lookup_join(fact, orders, "l_orderkey", "o_orderkey", on_duplicate="trust",
                           name="orders")
    if wanted & _NEEDS_PRODUCTS:
        fact = lookup_join(fact, product_lookup(spark, sf_dir), "l_partkey", "p_partkey",
                           on_duplicate="trust", name="products")
    quantity = F.col("l_quantity").cast("int")
    cost_factor = (F.lit(float(COST_BASE)) + F.col("l_discount") + F.col("l_tax"))
    exprs = {
        "order_number": F.col("l_orderkey").cast("string"),
        "quantity": quantity,
        "unit_price": F.col("unit_price").cast("decimal(18,2)"),
        "revenue": (quantity * F.col("unit_price")).cast("decimal(18,2)"),
        "cost": (F.col("unit_price") * cost_factor.cast("decimal(4,2)")).cast("decimal(18,4)"),
    }
    passthrough = [c for c in ("order_date", "customer_name", "channel", "product_name", "state",
                               "state_name", "us_region", "lat", "lon", "budget")
                   if c in fact.columns]
    fact = fact.select(*passthrough, *[e.alias(n) for n, e in exprs.items()
                                       if n in ("order_number", "quantity") or "unit_price" in fact.columns])
    if "budget" in fact.columns and "order_date" in fact.columns:
        fact = mask_outside_year(fact, "budget", "order_date", budget_year)
    if "cost" in fact.columns:
        fact = add_features(fact, order_date=None)
    if "order_date" in fact.columns:
        fact = calendar_features(fact)
    fact = conform(fact, [c for c in SALES_COLUMNS if c in wanted])
    return round_money(fact) if round_money_cols else fact


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """A materialised sales fact (Parquet) as the report input."""
    return conform(spark.read.parquet(path))


def sheets_from_tables(spark: SparkSession, sf_dir: str, budget_year: int = BUDGET_YEAR
                       ) -> dict[str, DataFrame]:
    """The driver's tables presented as the six raw sheets of the cleaning
    pipeline (reference column names; State Regions already has its header).

    Order lines carry a cost factor instead of the line total and unit cost;
    ``derive_line_measures`` rebuilds those two after the joins."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    lines = lookup_join(li.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"),
                        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
                        "l_orderkey", "o_orderkey", on_duplicate="trust", name="orders")
    sales_orders = lines.select(
        F.col("l_orderkey").cast("string").alias("OrderNumber"),
        F.col("o_orderdate").alias("OrderDate"),
        F.col("l_quantity").cast("int").alias("Order Quantity"),
        (F.lit(float(COST_BASE)) + F.col("l_discount") + F.col("l_tax")).cast("decimal(4,2)")
        .alias("Cost Factor"),
        F.col("o_custkey").alias("Customer Name Index"),
        F.col("l_partkey").alias("Product Description Index"))
    customers = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer Index"), F.col("c_name").alias("Customer Names"),
        F.col("c_mktsegment").alias("Channel"), F.col("c_nationkey").alias("Delivery Region Index"))
    part = read_table(spark, sf_dir, "part")
    products = part.select(F.col("p_partkey").alias("Index"), F.col("p_brand").alias("Product Name"),
                           F.col("p_retailprice").cast("decimal(10,2)").alias("Unit Price"))
    nation = read_table(spark, sf_dir, "nation")
    regions = nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("state_code"),
        F.col("n_name").alias("state"), F.col("n_nationkey").cast("double").alias("latitude"),
        F.col("n_regionkey").cast("double").alias("longitude"))
    region = read_table(spark, sf_dir, "region")
    state_regions = lookup_join(nation, region, "n_regionkey", "r_regionkey", on_duplicate="trust") \
        .select(F.col("n_nationkey").cast("string").alias("State Code"),
                F.col("r_name").alias("Region"))
    budgets = products.groupBy("Product Name").agg(
        (F.sum("Unit Price") * BUDGET_MULTIPLIER).cast("decimal(18,2)")
        .alias(f"{budget_year} Budgets"))
    return {"Sales Orders": sales_orders, "Customers": customers, "Products": products,
            "Regions": regions, "State Regions": state_regions,
            f"{budget_year} Budgets": budgets}


def derive_line_measures(df: DataFrame) -> DataFrame:
    """Line total and unit cost of the table-backed order sheet (after the joins)."""
    return df.withColumns({
        "line total": (F.col("order quantity") * F.col("unit price")).cast("decimal(18,2)"),
        "total unit cost": (F.col("unit price") * F.col("cost factor")).cast("decimal(18,4)"),
    })
