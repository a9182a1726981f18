"""S3 — the typed sales fact table (contract for every report).

Money is exact DECIMAL so that sums do not depend on partitioning; it is cast
to DOUBLE only in the final projection of each report.  Unit cost, total cost
and profit keep 4 decimals so one schema holds both the unrounded value and the
2-dp export (operator F6)."""

from pyspark.sql import types as T

SALES_SCHEMA = T.StructType([
    T.StructField("order_number", T.StringType(), False),
    T.StructField("order_date", T.DateType(), False),
    T.StructField("customer_name", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("unit_price", T.DecimalType(18, 2), False),
    T.StructField("revenue", T.DecimalType(18, 2), False),
    T.StructField("cost", T.DecimalType(18, 4), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("state_name", T.StringType(), False),
    T.StructField("us_region", T.StringType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("budget", T.DecimalType(18, 2), True),
    T.StructField("total_cost", T.DecimalType(18, 4), False),
    T.StructField("profit", T.DecimalType(18, 4), False),
    T.StructField("profit_margin_pct", T.DecimalType(9, 2), False),
    T.StructField("order_month_name", T.StringType(), False),
    T.StructField("month_no", T.IntegerType(), False),
])

SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

# Maximum text length of the NVARCHAR(50) columns (checked by the Q5 gate).
MAX_TEXT_LENGTH = 50


def conform(df, columns=None):
    """Project ``df`` onto the fact schema (column order and types); with
    ``columns``, onto that subset of the schema."""
    from pyspark.sql import functions as F
    keep = SALES_COLUMNS if columns is None else [c for c in SALES_COLUMNS if c in set(columns)]
    types = {f.name: f.dataType for f in SALES_SCHEMA.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in keep])
