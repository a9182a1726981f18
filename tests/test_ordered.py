"""G1-G3 distributed ordered operators equal the plain window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators import ordered, selection
from revlens.operators.ordered import (percentile_cont, percentile_values, with_ntile, with_ntiles,
                                       with_range_cumsum, with_rank, with_row_number)


def _frame(spark, n, distinct, seed):
    rnd = random.Random(seed)
    rows = [(f"k{i:05d}", rnd.randint(0, distinct)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v int")


@pytest.mark.parametrize("n,buckets", [(7, 5), (3, 5), (1, 5), (1500, 5), (2001, 10)])
def test_ntile_matches_window(spark, n, buckets):
    df = _frame(spark, n, 20, n)
    got = with_ntile(df, buckets, [("v", True), "k"], "b").select("k", "b")
    order = [F.col("v").desc(), F.col("k").asc()]
    want = df.select("k", F.ntile(buckets).over(Window.orderBy(*order)).alias("b"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_ntile_remainder_layout(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "v int")
    got = [r.b for r in with_ntile(df, 5, ["v"], "b")
           .orderBy("v").collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5]


def test_row_number_is_dense_and_ordered(spark):
    df = _frame(spark, 500, 1000, 3)
    got = with_row_number(df, ["v", "k"], "rn", num_partitions=5).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 501))
    keys = [(r.v, r.k) for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("desc", [True, False])
def test_rank_matches_window_with_heavy_ties(spark, desc):
    df = _frame(spark, 800, 12, 11)
    got = with_rank(df, "v", desc=desc, name="r", num_partitions=4).select("k", "r")
    order = F.col("v").desc() if desc else F.col("v").asc()
    want = df.select("k", F.rank().over(Window.orderBy(order)).alias("r"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_range_cumsum_matches_default_frame(spark):
    df = _frame(spark, 600, 30, 5)
    got = with_range_cumsum(df, "v", "v", desc=True, name="c", num_partitions=4) \
        .select("k", "c")
    want = df.select("k", F.sum("v").over(Window.orderBy(F.desc("v"))).alias("c"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_cont_matches_builtin(spark, p):
    df = _frame(spark, 301, 1000, 7).union(_frame(spark, 4, 1000, 8))
    got = percentile_cont(df, "v", p).first()[0]
    want = df.agg(F.percentile("v", p)).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_hot_value_is_not_funnelled(spark):
    """A third of the rows share one value: the rank still equals the window."""
    rows = [(f"h{i}", 7) for i in range(300)] + [(f"c{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = with_rank(df, "v", name="r", num_partitions=8).select("k", "r")
    want = df.select("k", F.rank().over(Window.orderBy(F.desc("v"))).alias("r"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("desc", [True, False])
def test_partitioned_rank_matches_window(spark, desc):
    rows = ([("big", f"b{i}", i % 17) for i in range(600)]          # one large group
            + [("small", f"s{i}", i % 5) for i in range(40)]
            + [(None, f"n{i}", None if i % 3 == 0 else i) for i in range(30)])
    df = spark.createDataFrame(rows, "g string, k string, v int")
    got = with_rank(df, "v", desc=desc, name="r", num_partitions=5,
                    partition_by="g").select("k", "r")
    order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
    want = df.select("k", F.rank().over(Window.partitionBy("g").orderBy(order)).alias("r"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.fixture
def tiny_samples(monkeypatch):
    """Brackets are wide, missed, and narrowed several times."""
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(selection, "BRACKET_ROWS", 120)


@pytest.mark.parametrize("distinct", [3, 10_000])
def test_selection_is_exact_whatever_the_sample(spark, tiny_samples, distinct):
    df = _frame(spark, 2500, distinct, distinct).repartition(5).checkpoint()
    order = [F.col("v").desc(), F.col("k").asc()]
    got = with_ntiles(df, 7, {"a": [("v", True), "k"], "b": ["v", "k"]}).select("k", "a", "b")
    want = df.select("k", F.ntile(7).over(Window.orderBy(*order)).alias("a"),
                     F.ntile(7).over(Window.orderBy("v", "k")).alias("b"))
    assert sorted(got.collect()) == sorted(want.collect())
    shares = [0.0, 0.1, 0.5, 0.73, 1.0]
    values = percentile_values(df.withColumn("w", F.col("v") * 2.5), {"v": shares, "w": [0.5]})
    want = df.agg(*[F.percentile("v", p) for p in shares]).first()
    assert values["v"] == pytest.approx(list(want), abs=1e-9)
    assert values["w"][0] == pytest.approx(want[2] * 2.5)


def test_a_bracket_that_misses_is_drawn_anew(spark, monkeypatch):
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 20)
    df = _frame(spark, 800, 10_000, 9).checkpoint()
    target = selection.Target
    monkeypatch.setattr(selection, "Target", lambda *a, **k: target(*a, **k, deviations=0))
    monkeypatch.setattr(target, "pick", _doubling(target.pick))
    assert percentile_values(df, {"v": [0.5]})["v"][0] == pytest.approx(
        df.agg(F.percentile("v", 0.5)).first()[0])


def _doubling(pick):
    def run(self, df):
        pick(self, df)
        self.deviations = max(self.deviations, 1)
    return run


def test_nulls_sort_lowest_and_are_no_values(spark):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (1, "c"), (None, "d"), (2, None)], "v int, k string")
    got = {(r.v, r.k): (r.d, r.a) for r in with_ntiles(
        df, 5, {"d": [("v", True), "k"], "a": ["v", "k"]}).collect()}
    assert got == {(3, "b"): (1, 5), (2, None): (2, 4), (1, "c"): (3, 3),
                   (None, "a"): (4, 1), (None, "d"): (5, 2)}
    hot = df.crossJoin(spark.range(400)).checkpoint()      # one key is all rows but a few
    assert percentile_values(hot, {"v": [0.4, 0.5]}) == {"v": [2.0, 2.0]}
    assert percentile_values(df, {"v": [0.5, 1.0]}) == {"v": [2.0, 3.0]}
    empty = df.filter("v > 9")
    assert percentile_values(empty, {"v": [0.5]}) == {"v": [None]}
    assert with_ntile(empty, 5, ["v", "k"]).collect() == []
    with pytest.raises(ValueError):
        with_ntile(df, 5, [("k", True)])


def test_selection_plans_hold_no_range_exchange(spark):
    df = _frame(spark, 300, 50, 2)
    plan = with_ntile(df, 5, ["v", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_and_running_sums_over_values_that_span_ranges(spark, parts):
    rows = [("g", f"h{i}", 7, 1) for i in range(200)] + [("f", f"x{i}", 7, 2) for i in range(90)] \
        + [("g", f"c{i}", i % 11, 3) for i in range(150)] + [(None, "n", None, None), ("g", "m", None, 4)]
    df = spark.createDataFrame(rows, "g string, k string, v int, w int")
    for desc in (True, False):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        got = with_rank(df, "v", desc, "r", parts)
        got = with_rank(got, "v", desc, "p", parts, partition_by="g")
        got = with_range_cumsum(got, "v", "w", desc, "c", parts).select("k", "r", "p", "c")
        want = df.select("k", F.rank().over(Window.orderBy(order)).alias("r"),
                         F.rank().over(Window.partitionBy("g").orderBy(order)).alias("p"),
                         F.sum("w").over(Window.orderBy(order)).alias("c"))
        assert sorted(got.collect()) == sorted(want.collect())


def test_a_hot_value_is_spread_over_the_ranges(spark):
    """A third of the rows on one value, AQE off: no range holds much more
    than the others, and nothing is joined on the value."""
    rows = [(f"h{i}", 7.5) for i in range(1000)] + [(f"c{i}", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = with_rank(df, "v", name="r", num_partitions=12)
        sizes = [r[1] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 and "SortMergeJoin" not in plan
    laid = ordered.sorted_ranges(df.withColumn("t", F.monotonically_increasing_id()),
                                 [F.col("v"), "t"], 12)
    held = sorted(r["count"] for r in laid.groupBy("_rid").count().collect())
    assert held[-1] <= 2 * held[len(held) // 2]
