"""The queries that have a SQL form, against DuckDB."""

import duckdb
import pytest

from meterwise.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = sorted(map(str, want.fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == rows
