"""Plan checks on the stored fact: no report funnels fact rows into a single
partition (every SinglePartition exchange sits above an aggregate or a small
materialised table, never directly above the Parquet scan of the fact)."""

import re

import pytest

from revlens.plans.registry import DERIVED, REPORTS
from revlens.sources.sinks import read_sales_table, write_sales_table
from revlens.sources.tables import sales_fact

PASS_THROUGH = ("Project", "Filter", "ColumnarToRow", "InputAdapter", "WholeStageCodegen",
                "AQEShuffleRead", "ShuffleQueryStage")


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact")) + "/sales"
    write_sales_table(sales_fact(spark, sf_dir), path)
    return read_sales_table(spark, path)


def _children(lines, i):
    depth = len(lines[i]) - len(lines[i].lstrip(" :+-"))
    for line in lines[i + 1:]:
        d = len(line) - len(line.lstrip(" :+-"))
        if d <= depth:
            return
        yield line.strip(" :+-*()0123456789")


def _single_partition_over_scan(plan: str) -> bool:
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        for child in _children(lines, i):
            if child.startswith(PASS_THROUGH):
                continue
            if re.match(r"(FileScan|Scan parquet)", child):
                return True
            break
    return False


@pytest.mark.parametrize("name", sorted({**REPORTS, **DERIVED}))
def test_no_single_partition_over_fact_scan(spark, stored, name):
    report = {**REPORTS, **DERIVED}[name].__wrapped__
    df = report(stored)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not _single_partition_over_scan(plan), plan


def test_detector_flags_raw_window_total(spark, stored):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    raw = stored.select("channel", F.sum("revenue").over(Window.partitionBy()).alias("t"))
    raw.collect()
    assert _single_partition_over_scan(raw._jdf.queryExecution().executedPlan().toString())
