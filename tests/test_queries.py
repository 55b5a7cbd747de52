"""Every registered query against its DuckDB check, at the smallest scale."""

import glob
import os

import duckdb
import pytest
from tools.compare import rows_of

import __spark_entry__ as entry
from spindlewatch.plans.registry import batch_queries
from spindlewatch.plans.stream_registry import stream_queries

# long-running streams that test_streams covers with several micro-batches
COVERED = {"stream_windows", "stream_spike", "stream_pairs", "stream_status", "stream_health"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


# those of subpackage llm have tests of their own
OWN = {**batch_queries(), **stream_queries()}


@pytest.mark.parametrize("name", [q for q in OWN if q not in COVERED])
def test_query_matches_check(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    got = rows_of(df.columns, df.collect())
    check = entry.oracle_sql().get(name)
    if check is None:
        assert got
        return
    cur = duck.execute(check)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OWN) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "alert_time"
