"""Every query outside the optional subpackage against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from kgspark.plans import catalog

FOLDER = os.environ.get("KGSPARK_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value in a form that both engines share."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, duck, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
