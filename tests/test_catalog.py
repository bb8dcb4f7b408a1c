"""Every query with SQL against DuckDB on the smallest tables."""

import collections
import decimal
import glob
import math
import os

import duckdb
import pytest

from simvane.plans import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert collections.Counter(tuple(plain(r[n]) for n in names) for r in rows) == collections.Counter(tuple(plain(v) for v in r) for r in want.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["q", "n", "rank", "d"] and out.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
