"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from isofield.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or repr(x) in ("<NA>", "NaT"):
        return None
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 7) + 0.0
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6 * max(1.0, abs(v))), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
