"""The queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from oracle import duck, normal
from traitweave.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    pytest.importorskip("duckdb")
    df = Q.QUERIES[name](spark, SF)
    cur = duck(SF).execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(names, cur.fetchall())
