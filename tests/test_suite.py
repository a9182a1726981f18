"""The shared-grain suite equals the single-report functions."""

import pytest

from revlens.plans.registry import DERIVED, REPORTS
from revlens.plans.suite import CATALOGUE, run_reports
from revlens.sources.tables import sales_fact

SINGLE = {**REPORTS, **DERIVED}


def test_catalogue_covers_every_report():
    assert set(CATALOGUE) == set(SINGLE)


@pytest.fixture(scope="module")
def suite(spark, sf_dir):
    return run_reports(sales_fact(spark, sf_dir))


@pytest.mark.parametrize("name", sorted(SINGLE))
def test_suite_equals_single_report(spark, sf_dir, suite, name):
    single = SINGLE[name](spark, sf_dir)
    shared = suite[name]
    assert shared.columns == single.columns
    assert shared.collect() == single.collect()      # same rows in the same order


def test_subset_pulls_prerequisites(spark, sf_dir):
    out = run_reports(sales_fact(spark, sf_dir), ["d7_abc_mix"])
    assert list(out) == ["d7_abc_mix"] and out["d7_abc_mix"].count() == 3


def test_parallel_execution_equals_sequential(spark, sf_dir, suite):
    from revlens.plans.suite import execute_reports
    rows = execute_reports(sales_fact(spark, sf_dir), lambda name, df: df.collect(), parallel=4)
    assert set(rows) == set(SINGLE)
    for name in ("b07_customer_ranking", "b10_rfm_segmentation", "d3_rfm_segment_mix",
                 "d7_abc_mix", "b18_abc_pareto"):
        assert rows[name] == suite[name].collect()


def test_the_fact_is_read_twice(tmp_path):
    """By Spark's event log, in a session of its own: rows read from the
    stored fact while all grains are built."""
    import json
    import subprocess
    import sys
    script = f'''
import sys
sys.path[:0] = {sys.path!r}
from revlens.session import local_session
from revlens.plans import suite
from revlens.sources.sinks import read_sales_table, write_sales_table
from revlens.sources.tables import sales_fact
spark = local_session(4, 4, extra={{"spark.eventLog.enabled": "true",
                                   "spark.eventLog.dir": "file://{tmp_path}/events",
                                   "spark.eventLog.rolling.enabled": "false",
                                   "spark.eventLog.compress": "false"}})
write_sales_table(sales_fact(spark, "/root/testdata/sf0.001"), "{tmp_path}/fact")
sales = read_sales_table(spark, "{tmp_path}/fact")
spark.sparkContext.setJobDescription("grains")
grains = suite._grains_for(sales, list(suite.CATALOGUE), 1)
assert set(grains) == set(suite.GRAINS)
print("ROWS", sales.select("quantity").count())
'''
    (tmp_path / "events").mkdir()
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    rows = int(out.stdout.split("ROWS")[1])
    stages, read = set(), 0
    for line in next((tmp_path / "events").iterdir()).open():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart" and \
                event["Properties"].get("spark.job.description") == "grains":
            stages.update(event["Stage IDs"])
        if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in stages:
            read += event["Task Metrics"]["Input Metrics"]["Records Read"]
    assert rows and read - rows <= 2 * rows          # the count above reads it once more
