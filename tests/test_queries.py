"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import math
import os

import duckdb
import pandas as pd
import pytest

from threadlake.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, int, float)) or hasattr(v, "item"):
        return float(v)
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None))
    return str(v)


def rows(df):
    """Rows in one order; figures with fractions, which may differ in the last rounded place, decide last."""
    out = [tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    exact = lambda x: not isinstance(x, float) or x == int(x)
    return sorted(out, key=lambda r: ([str(x) for x in r if exact(x)], [x for x in r if not exact(x)]))


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1.5e-4))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
        assert not wrong, wrong[:3]
    else:
        assert len(got) > 0
