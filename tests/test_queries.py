"""Every query of the library against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest
from quillon import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(([plain(x) for x in r] for r in frame[names].itertuples(index=False)), key=repr)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    names, got = rows(plans.QUERIES[name](spark, FOLDER).toPandas())
    assert name in plans.ORACLE_SQL
    wanted, want = rows(db.sql(plans.ORACLE_SQL[name]).df())
    assert names == wanted and len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
