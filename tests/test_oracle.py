"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from kinetrail.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


def test_entry(spark):
    df = catalog.flagship(spark, DIR)
    row = df.orderBy("traj", "t").first()
    assert df.count() == 1000 and len(row.history) == 3 and len(row.actions) == 4
