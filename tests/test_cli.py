"""The command line over reference-shaped CSV sheets: clean -> table -> reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from revlens.__main__ import main
from revlens.sources.sinks import read_sales_table, write_csv
from revlens.sources.tables import sales_fact, sheets_from_tables


def _reference_sheets(spark, sf_dir, out):
    """The six sheets as the reference has them, written as CSV files."""
    sheets = sheets_from_tables(spark, sf_dir)
    products = sheets["Products"]
    orders = (sheets["Sales Orders"]
              .join(products.select(F.col("Index").alias("_pk"), "Unit Price"),
                    F.col("Product Description Index") == F.col("_pk"), "left")
              .withColumn("Line Total", (F.col("Order Quantity") * F.col("Unit Price"))
                          .cast("decimal(18,2)"))
              .withColumn("Total Unit Cost", (F.col("Unit Price") * F.col("Cost Factor"))
                          .cast("decimal(18,4)"))
              .drop("_pk", "Cost Factor"))
    customers = sheets["Customers"].drop("Channel", "Delivery Region Index")
    # channel and delivery region live on the order sheet in the reference
    cust_attrs = sheets["Customers"].select(F.col("Customer Index").alias("_ck"), "Channel",
                                            "Delivery Region Index")
    orders = orders.join(cust_attrs, F.col("Customer Name Index") == F.col("_ck"), "left") \
        .drop("_ck")
    header = [("State Code", "Region")]
    state_rows = [tuple(r) for r in sheets["State Regions"].collect()]      # 25 rows
    state = spark.createDataFrame(header + state_rows, "c0 string, c1 string").coalesce(1)
    frames = {"Sales Orders": orders, "Customers": customers,
              "Products": products.drop("Unit Price"), "Regions": sheets["Regions"],
              "State Regions": state, "2000 Budgets": sheets["2000 Budgets"]}
    catalog = {}
    for name, df in frames.items():
        path = os.path.join(out, name.replace(" ", "_"))
        write_csv(df, path)
        catalog[name] = path
    return catalog


def test_clean_then_report_all(spark, sf_dir, scratch):
    catalog = _reference_sheets(spark, sf_dir, os.path.join(scratch, "sheets"))
    cat_file = os.path.join(scratch, "catalog.json")
    with open(cat_file, "w") as fh:
        json.dump(catalog, fh)
    fact_dir = os.path.join(scratch, "fact")
    assert main(["clean", "--sheets", cat_file, "--out", fact_dir, "--format", "csv",
                 "--budget-year", "2000"]) == 0
    cleaned = read_sales_table(spark, fact_dir)
    expected = sales_fact(spark, sf_dir, round_money_cols=True)
    assert cleaned.schema == expected.schema
    assert cleaned.exceptAll(expected).count() == 0 and expected.exceptAll(cleaned).count() == 0

    out = os.path.join(scratch, "reports")
    assert main(["report", "all", "--fact", fact_dir, "--out", out]) == 0
    written = sorted(os.listdir(out))
    assert "b10_rfm_segmentation" in written and "d7_abc_mix" in written and len(written) == 27
    rfm = spark.read.option("header", "true").csv(os.path.join(out, "b10_rfm_segmentation"))
    assert rfm.count() == expected.select("customer_name").distinct().count()


def test_clean_names_the_lookup_that_lost_rows(spark, sf_dir, scratch, capsys):
    catalog = _reference_sheets(spark, sf_dir, os.path.join(scratch, "sheets"))
    customers = spark.read.option("header", "true").csv(catalog["Customers"])
    fewer = os.path.join(scratch, "fewer")
    write_csv(customers.filter(F.col("Customer Index").cast("long") % 5 != 0), fewer)
    twice = os.path.join(scratch, "twice")
    write_csv(customers.unionByName(customers.filter(F.col("Customer Index").cast("long") < 4)), twice)
    for at, said in ((fewer, "Customers: .* without a match"), (twice, r"duplicate keys in Customers \(")):
        cat_file = os.path.join(scratch, "catalog.json")
        with open(cat_file, "w") as fh:
            json.dump({**catalog, "Customers": at}, fh)
        with pytest.raises(ValueError, match=said):
            main(["clean", "--sheets", cat_file, "--out", os.path.join(scratch, "no"), "--budget-year",
                  "2000"])
        assert not os.path.exists(os.path.join(scratch, "no"))
    shown = capsys.readouterr().out
    assert "Products: " in shown and " 0 without a match, 0 without a key" in shown


def test_report_parameters(spark, sf_dir, scratch, capsys):
    fact = os.path.join(scratch, "fact")
    assert main(["build-fact", "--tables", sf_dir, "--out", fact]) == 0

    def shown(*args):
        capsys.readouterr()
        assert main(["report", *args, "--fact", fact, "--show", "50"]) == 0
        return capsys.readouterr().out

    assert shown("b03_top_products_revenue", "--top", "3").count("Row(") == 3
    assert "1996_M" in shown("b16_month_year_pivot", "--years", "1996", "1997")
    assert shown("d7_abc_mix", "--abc-cuts", "0.1", "0.2") != shown("d7_abc_mix")
    assert shown("d3_rfm_segment_mix", "--recency", "50", "100", "200", "400") != shown("d3_rfm_segment_mix")
    with pytest.raises(SystemExit):
        main(["report", "b01_monthly_trend", "--top", "3", "--fact", fact])


def test_build_fact_and_list(spark, sf_dir, scratch, capsys):
    fact_dir = os.path.join(scratch, "fact")
    assert main(["build-fact", "--tables", sf_dir, "--out", fact_dir]) == 0
    assert read_sales_table(spark, fact_dir).count() == sales_fact(spark, sf_dir).count()
    assert main(["list"]) == 0
    assert "b18_abc_pareto" in capsys.readouterr().out
