"""Every query against its SQL in DuckDB on the small tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = FOLDER / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((str([plain(r[i]) for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, str(FOLDER))
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
