"""Queries of this package against their SQL."""

import duckdb
import pytest

from weftline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small}/{table}.parquet')")
    found = queries.queries()[name](spark, small)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(result.fetchall())
