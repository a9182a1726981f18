"""S1 multi-sheet load and S4 typed bulk load.

A workbook is re-aimed as a catalogue ``{sheet name: path}`` of CSV or
Parquet files (the binary .xlsx format has no distributed reader); each
sheet is read lazily and in parallel by Spark.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.operators.ordered import materialize
from revlens.operators.quality import CORRUPT_RECORD, split_by_reasons, with_reasons
from revlens.schema import SALES_SCHEMA

# The six sheets the cleaning pipeline reads.
REQUIRED_SHEETS = ("Sales Orders", "Customers", "Products", "Regions", "State Regions",
                   "2017 Budgets")


# Types of the sheets' columns (names folded); all others, the
# order numbers among them, are text and keep every character.
SHEET_TYPES = {
    "orderdate": "date", "order quantity": "int", "unit price": "decimal(18,2)",
    "line total": "decimal(18,2)", "total unit cost": "decimal(18,4)",
    "cost factor": "decimal(4,2)", "customer name index": "long",
    "product description index": "long", "delivery region index": "long",
    "customer index": "long", "index": "long", "id": "long", "latitude": "double",
    "longitude": "double",
}
BUDGET_TYPE = "decimal(18,2)"   # of the column named '<year> budgets'


def _sheet_type(name: str) -> str | None:
    folded = name.strip().lower()
    return BUDGET_TYPE if folded.endswith(" budgets") else SHEET_TYPES.get(folded)


def gated_sheet(df: DataFrame) -> DataFrame:
    """The sheet with its columns in their fixed types and ``reasons``: the
    columns whose value does not fit (``'Order Quantity:type'``) and is
    therefore NULL.  The same with ANSI mode on and off."""
    kinds = {c: _sheet_type(c) for c in df.columns}
    values = {c: F.col(f"`{c}`") for c in df.columns}
    misfit = [F.when(values[c].isNotNull() & values[c].try_cast(kind).isNull(), F.lit(f"{c}:type"))
              for c, kind in kinds.items() if kind]
    return df.select(*[(values[c].try_cast(kind) if kind else values[c]).alias(c)
                       for c, kind in kinds.items()],
                     F.array_compact(F.array(*misfit)).cast("array<string>").alias("reasons"))


def typed_sheet(df: DataFrame) -> DataFrame:
    """The sheet with its columns in their fixed types; a value that does not
    fit its type is an error when the sheet is read, in every session."""
    def column(name: str, kind: str):
        value = F.col(f"`{name}`")
        typed = value.try_cast(kind)
        said = F.concat(F.lit(f"{name}: not a {kind}: "), value.cast("string"))
        return F.when(value.isNotNull() & typed.isNull(), F.raise_error(said).cast(kind)) \
            .otherwise(typed).alias(name)

    return df.select(*[column(c, _sheet_type(c)) if _sheet_type(c) else F.col(f"`{c}`")
                       for c in df.columns])


def load_gated_sheets(spark: SparkSession, catalog: Mapping[str, str], fmt: str = "csv",
                      required: Sequence[str] = (), options: Mapping[str, str] | None = None
                      ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """S1 with a gate: (accepted, quarantined) rows of every sheet; a rejected
    row carries ``reasons``.  Each sheet is parsed and judged once."""
    raw = _raw_sheets(spark, catalog, fmt, required, options)
    tagged = {name: materialize(gated_sheet(df)) for name, df in raw.items()}
    return ({n: df.filter(F.size("reasons") == 0).drop("reasons") for n, df in tagged.items()},
            {n: df.filter(F.size("reasons") > 0) for n, df in tagged.items()})


POSITION = "_position"


def positioned_sheet(spark: SparkSession, path: str, fmt: str = "csv",
                     options: Mapping[str, str] | None = None) -> DataFrame:
    """A sheet without a header line, each row with its place in the source,
    from the files' metadata: the file, the start of its block, and the row's
    place there (Parquet: its row index in the file).  ``promote_header`` takes
    the column as ``order_col``."""
    df = spark.read.format(fmt).options(**dict(options or {})).load(path)
    meta = F.col("_metadata")
    if fmt == "parquet":
        place = F.struct(meta["file_path"].alias("file"), F.lit(0).cast("long").alias("block"),
                         meta["row_index"].alias("row"))
    else:
        # rows of a block are read in order by one task
        place = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"),
                         F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(POSITION))


def _raw_sheets(spark, catalog, fmt, required, options) -> dict[str, DataFrame]:
    missing = [s for s in required if s not in catalog]
    if missing:
        raise KeyError(f"missing sheets: {missing}")
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
    return {name: spark.read.format(fmt).options(**opts).load(path) for name, path in catalog.items()}


def load_sheets(spark: SparkSession, catalog: Mapping[str, str], fmt: str = "parquet",
                required: Sequence[str] = (), options: Mapping[str, str] | None = None
                ) -> dict[str, DataFrame]:
    """Read every sheet of a catalogue; a missing required sheet fails by
    name.  CSV sheets are read as text and typed by ``typed_sheet``: nothing is
    inferred, so keys keep their leading zeros and no sheet is read twice."""
    sheets = _raw_sheets(spark, catalog, fmt, required, options)
    return {name: typed_sheet(df) for name, df in sheets.items()} if fmt == "csv" else sheets


def bulk_load_csv(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA,
                  strict_header: bool = False, null_value: str = "") -> DataFrame:
    """Typed CSV load with a header row (``FIRSTROW = 2``).

    Columns bind by **position** (the reference's header says
    ``order_month_num`` where the table says ``month_no``); with
    ``strict_header=True`` a header that does not match the schema names is
    an error instead.  CRLF line ends, quoted commas and empty fields (NULL)
    are handled by the CSV reader.  A malformed row (a value that does not fit
    its type, a field too many or too few) stops the load;
    :func:`load_gated_csv` quarantines such rows instead."""
    reader = (spark.read.schema(_nullable(schema))
              .option("header", "true")
              .option("enforceSchema", "false" if strict_header else "true")
              .option("nullValue", null_value)
              .option("mode", "FAILFAST"))
    return reader.csv(path)


def csv_with_corrupt(reader, schema: T.StructType = SALES_SCHEMA, null_value: str = ""):
    """A batch or streaming CSV reader that keeps the text of malformed rows in
    ``_corrupt_record``, which the gate reports."""
    fields = [*_nullable(schema).fields, T.StructField(CORRUPT_RECORD, T.StringType(), True)]
    return (reader.schema(T.StructType(fields))
            .option("header", "true").option("enforceSchema", "true")
            .option("nullValue", null_value).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT_RECORD))


def load_gated_csv(spark: SparkSession, path: str, schema: T.StructType = SALES_SCHEMA
                   ) -> tuple[DataFrame, DataFrame]:
    """S4 with the Q5 gate as one operation: (accepted, quarantined) rows of a
    CSV export.  The file is parsed and judged once; both results read the
    same materialised rows."""
    tagged = materialize(with_reasons(csv_with_corrupt(spark.read, schema).csv(path), schema))
    return split_by_reasons(tagged)


def _nullable(schema: T.StructType) -> T.StructType:
    # the reader must accept NULLs so that the gate can report them
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
