"""Training-data queries against their DuckDB SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from revlens.llm import registry
from tools.oracle_check import TABLES, compare

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(ORACLES) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    ok, msg = compare(registry.queries()[name](spark, sf_dir), duck.sql(ORACLES[name]))
    assert ok, msg
