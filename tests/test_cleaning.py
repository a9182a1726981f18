"""Cleaning pipeline (P1-P7, J1-J6, F1-F6), sources and sinks."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.operators.cleaning import (apply_collation, mask_outside_year, normalize_columns,
                                        promote_header, rename_simultaneous, select_strict)
from revlens.operators.features import round_money
from revlens.operators.joins import DuplicateKeyError, lookup_join
from revlens.plans.enrichment import clean_sales
from revlens.schema import SALES_COLUMNS
from revlens.sources.sheets import bulk_load_csv, load_sheets
from revlens.sources.sinks import read_sales_table, write_csv, write_sales_table
from revlens.sources.tables import derive_line_measures, sales_fact, sheets_from_tables


def test_pipeline_round_trip_equals_fact(spark, sf_dir):
    piped = clean_sales(sheets_from_tables(spark, sf_dir), budget_year=2000, state_header=None,
                        derive=derive_line_measures, round_money_cols=False)
    fact = sales_fact(spark, sf_dir)
    assert piped.columns == SALES_COLUMNS
    assert piped.schema == fact.schema
    assert piped.exceptAll(fact).count() == 0 and fact.exceptAll(piped).count() == 0


def test_rename_is_simultaneous(spark):
    df = spark.createDataFrame([("CA", "California")], "state_code string, state string")
    out = rename_simultaneous(df, {"state_code": "state", "state": "state_name"})
    assert out.columns == ["state", "state_name"]
    assert tuple(out.first()) == ("CA", "California")


def test_rename_missing_column_errors(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        rename_simultaneous(df, {"b": "c"})


def test_select_strict_errors_on_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        select_strict(df, ["a", "b"])


def test_promote_header_by_values_and_fold(spark):
    raw = spark.createDataFrame([("State Code ", "Region"), ("CA", "West"), ("TX", "South")],
                                "c0 string, c1 string")
    out = normalize_columns(promote_header(raw, header_values=("State Code ", "Region")))
    assert out.columns == ["state code", "region"]
    assert sorted(tuple(r) for r in out.collect()) == [("CA", "West"), ("TX", "South")]


def test_promote_header_by_position(spark):
    raw = spark.createDataFrame([(0, "code", "region"), (1, "CA", "West")],
                                "pos long, a string, b string")
    out = promote_header(raw, order_col="pos")
    assert out.columns == ["code", "region"] and out.count() == 1


def test_fold_collision_errors(spark):
    df = spark.createDataFrame([(1, 2)], "`A` int, `a ` int")
    with pytest.raises(ValueError):
        normalize_columns(df)


def test_budget_mask(spark):
    df = spark.createDataFrame([(date(2016, 5, 1), 1.0), (date(2017, 5, 1), 2.0), (None, 3.0)],
                               "d date, budget double")
    got = [r.budget for r in mask_outside_year(df, "budget", "d", 2017).collect()]
    assert got == [None, 2.0, None]


def test_duplicate_lookup_key_errors_or_dedupes(spark):
    fact = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, name string, o int")
    with pytest.raises(DuplicateKeyError):
        lookup_join(fact, dim, "k", "id")
    out = lookup_join(fact, dim, "k", "id", on_duplicate="first", order_by="o")
    assert sorted((r.k, r.name) for r in out.collect()) == [(1, "a"), (2, "c")]


def test_null_keys_match_only_in_parity_mode(spark):
    fact = spark.createDataFrame([(None,), (1,)], "k int")
    dim = spark.createDataFrame([(None, "n"), (1, "one")], "id int, name string")
    plain = lookup_join(fact, dim, "k", "id")
    parity = lookup_join(fact, dim, "k", "id", null_safe=True)
    assert sorted(str(r.name) for r in plain.collect()) == ["None", "one"]
    assert sorted(r.name for r in parity.collect()) == ["n", "one"]


def test_lookup_join_rejects_ambiguous_columns(spark):
    fact = spark.createDataFrame([(1, "x")], "k int, name string")
    dim = spark.createDataFrame([(1, "y")], "id int, name string")
    with pytest.raises(ValueError):
        lookup_join(fact, dim, "k", "id")


def test_round_money_half_even_after_features(spark, sf_dir):
    fact = sales_fact(spark, sf_dir)
    rounded = round_money(fact)
    row = rounded.agg(F.max(F.col("cost") * 100 - F.floor(F.col("cost") * 100)).alias("frac")).first()
    assert row.frac == 0
    assert rounded.schema == fact.schema


def test_csv_round_trip_positional_and_strict(spark, scratch):
    fact = sales_fact(spark, "/root/testdata/sf0.001").limit(50)
    renamed = fact.withColumnRenamed("month_no", "order_month_num")   # the export's header
    write_csv(renamed, f"{scratch}/csv")
    back = bulk_load_csv(spark, f"{scratch}/csv")
    assert back.columns == SALES_COLUMNS and back.count() == 50
    with pytest.raises(Exception):
        bulk_load_csv(spark, f"{scratch}/csv", strict_header=True).collect()


def test_csv_crlf_quoted_comma_and_empty_field(spark, scratch):
    header = ",".join(SALES_COLUMNS)
    row = ('1,2014-01-02,"Smith, Inc",Wholesale,P1,2,10.00,20.00,6.0000,CA,California,West,'
           '1.0,2.0,,12.0000,8.0000,40.00,January,1')
    with open(f"{scratch}/x.csv", "w", newline="") as fh:
        fh.write(header + "\r\n" + row + "\r\n")
    got = bulk_load_csv(spark, f"{scratch}/x.csv").first()
    assert got.customer_name == "Smith, Inc" and got.budget is None and got.month_no == 1
    assert got.revenue == Decimal("20.00")


def test_sales_table_write_and_read(spark, scratch, sf_dir):
    fact = sales_fact(spark, sf_dir)
    write_sales_table(fact, f"{scratch}/t")
    back = read_sales_table(spark, f"{scratch}/t")
    assert back.columns == SALES_COLUMNS
    assert back.exceptAll(fact).count() == 0 and back.count() == fact.count()


def test_load_sheets_missing_sheet(spark):
    with pytest.raises(KeyError):
        load_sheets(spark, {"Sales Orders": "/nowhere"}, required=("Sales Orders", "Customers"))


def test_collation_option_groups_case_and_trailing_blanks(spark):
    df = spark.createDataFrame([("Ab",), ("aB ",), ("c",)], "name string")
    assert df.groupBy("name").count().count() == 3
    assert apply_collation(df, ["name"]).groupBy("name").count().count() == 2


def test_date_range_read_prunes_partitions(spark, scratch, sf_dir):
    fact = sales_fact(spark, sf_dir)
    write_sales_table(fact, f"{scratch}/t")
    part = read_sales_table(spark, f"{scratch}/t", start="2000-03-01", end="2000-05-31")
    want = fact.filter(F.col("order_date").between("2000-03-01", "2000-05-31"))
    assert part.exceptAll(want).count() == 0 and want.exceptAll(part).count() == 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date" in plan
