"""The corpus queries that SQL can express, against it; at the smallest scale."""

import duckdb
import pytest

from vectrine.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    a, b = sorted(tuple(r) for r in got.select(*columns).collect()), sorted(want.fetchall())
    assert a == b
