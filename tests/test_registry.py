"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import duck, normal
from traitweave import workload

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(df.columns, got) == normal(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(workload.queries()) - set(workload.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert workload.queries()[name](spark, SF).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
