"""Every registered query of the terminology engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(map(tidy, r)) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(tidy(r[c]) for c in cols) for r in got.collect()), key=repr)
    assert len(have) == len(want)
    assert have == want
