"""Every query with SQL against DuckDB over the smallest tables, where these are there."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, bool | str | int):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    try:
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    except TypeError:
        return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    expected = sorted((tuple(plain(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == expected


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["gram", "n", "label", "gram_count", "hits", "score"]
