"""The numbered queries that have SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from brindle.llm import oracles, queries
from tests.test_oracles import bag


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_numbered_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf), con.execute(oracles.oracle_sql()[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, rows)
