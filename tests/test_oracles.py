"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from marlspike.queries import ORACLES, QUERIES
from marlspike.session import TABLES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in ORACLES:
        res = db.execute(ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
