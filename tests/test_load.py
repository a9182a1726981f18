"""CSV input: malformed rows, failures between writes, headers, key text."""

import os

import pytest
from pyspark.sql import functions as F

from revlens.operators.cleaning import promote_header
from revlens.schema import SALES_COLUMNS
from revlens.sources import publish, sinks
from revlens.sources.sheets import (bulk_load_csv, load_gated_csv, load_gated_sheets, load_sheets,
                                    positioned_sheet)
from revlens.sources.sinks import publish_load, read_quarantine, read_sales_table, write_csv
from revlens.sources.tables import sales_fact
from revlens.streaming import incremental

GOOD = ('1,2014-01-02,"Smith, Inc",Wholesale,P1,2,10.00,20.00,6.0000,CA,California,West,'
        '1.0,2.0,,12.0000,8.0000,40.00,January,1')


def _file(path, *rows):
    with open(path, "w") as fh:
        fh.write("\n".join([",".join(SALES_COLUMNS), *rows]) + "\n")
    return str(path)


def test_malformed_values_and_surplus_fields_are_quarantined(spark, tmp_path):
    path = _file(tmp_path / "x.csv", GOOD, GOOD.replace(",,12", ",12O0.00,12"), GOOD + ",x,y")
    accepted, rejected = load_gated_csv(spark, path)
    assert accepted.columns == SALES_COLUMNS and accepted.count() == 1
    assert [r.reasons for r in rejected.collect()] == [["record:malformed"]] * 2
    with pytest.raises(Exception):
        bulk_load_csv(spark, path).collect()


def test_a_batch_that_fails_between_its_writes_is_not_loaded_twice(spark, tmp_path, sf_dir,
                                                                  monkeypatch):
    landing, table, quarantine, ckpt = (str(tmp_path / n) for n in ("in", "t", "q", "c"))
    write_csv(sales_fact(spark, sf_dir).limit(30), os.path.join(landing, "batch1"))
    whole = incremental.split_by_reasons

    class Broken:
        def withColumn(self, *_):
            raise OSError("the quarantine folder is full")

    monkeypatch.setattr(incremental, "split_by_reasons", lambda t: (whole(t)[0], Broken()))
    with pytest.raises(Exception):
        incremental.incremental_load(spark, landing + "/*", table, quarantine, ckpt) \
            .awaitTermination(120)
    monkeypatch.setattr(incremental, "split_by_reasons", whole)
    incremental.incremental_load(spark, landing + "/*", table, quarantine, ckpt).awaitTermination(120)
    assert spark.read.parquet(table).count() == 30


def test_keys_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "o.csv").write_text("OrderNumber,Order Quantity,OrderDate\n000101,3,2014-05-06\n")
    row = load_sheets(spark, {"Sales Orders": str(tmp_path / "o.csv")}, fmt="csv")["Sales Orders"].first()
    assert row.OrderNumber == "000101" and row["Order Quantity"] == 3 and row.OrderDate.year == 2014


def test_header_is_matched_folded_and_must_be_there(spark):
    rows = [(" State Code", "Region "), ("CA", "West")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert promote_header(df, ("state code", "Region")).collect() == [("CA", "West")]
    with pytest.raises(ValueError):
        promote_header(df.filter("a = 'CA'"), ("State Code", "Region"))
    with pytest.raises(ValueError):
        promote_header(df.union(df), ("State Code", "Region"))
    placed = df.union(df).withColumn("pos", F.monotonically_increasing_id())
    assert promote_header(placed, ("State Code", "Region"), "pos").count() == 3


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_sheet_value_that_does_not_fit_is_an_error_or_quarantined(spark, tmp_path, ansi):
    (tmp_path / "o.csv").write_text("OrderNumber,Order Quantity,Line Total\n01,3,10.50\n02,x,12O0.00\n"
                                    "03,,7\n")
    at = {"Sales Orders": str(tmp_path / "o.csv")}
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a"):
            load_sheets(spark, at, fmt="csv")["Sales Orders"].collect()
        accepted, rejected = load_gated_sheets(spark, at)
        assert [r.OrderNumber for r in accepted["Sales Orders"].orderBy("OrderNumber").collect()] == ["01", "03"]
        assert rejected["Sales Orders"].first().reasons == ["Order Quantity:type", "Line Total:type"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_header_by_position_keeps_a_data_row_that_equals_it(spark, tmp_path, fmt):
    rows = [("State Code", "Region"), ("CA", "West"), ("State Code", "Region"), ("NY", "East")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    path = str(tmp_path / fmt)
    df.write.format(fmt).save(path)
    sheet = positioned_sheet(spark, path, fmt).repartition(3)
    body = promote_header(sheet, ("state code", "Region"), "_position")
    assert sorted(map(tuple, body.collect())) == sorted(rows[1:])
    assert body.columns == promote_header(sheet, order_col="_position").columns == ["State Code", "Region"]


def test_a_load_that_dies_between_its_writes_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    first = _file(tmp_path / "a.csv", GOOD, GOOD + ",x")
    publish_load(*load_gated_csv(spark, first), table)
    assert read_sales_table(spark, table).count() == 1 and read_quarantine(spark, table).count() == 1

    second = _file(tmp_path / "b.csv", GOOD, GOOD, GOOD)
    accepted, rejected = load_gated_csv(spark, second)

    class Dies:
        write = property(lambda self: (_ for _ in ()).throw(OSError("killed between the writes")))

    with pytest.raises(OSError):
        publish_load(accepted, Dies(), table)
    assert read_sales_table(spark, table).count() == 1 and read_quarantine(spark, table).count() == 1

    publish_load(accepted, rejected, table, str(tmp_path / "rejects"))
    assert read_sales_table(spark, table).count() == 3 and read_quarantine(spark, table).count() == 0
    assert publish.published(spark, table)["quarantined"].startswith(str(tmp_path / "rejects"))
    assert publish.published(spark, str(tmp_path / "nothing")) is None
    sinks.write_sales_table(accepted, str(tmp_path / "plain"))
    assert read_sales_table(spark, str(tmp_path / "plain")).count() == 3
