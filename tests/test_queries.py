"""Every query with SQL against DuckDB, over sf0.001."""

import os
from collections import Counter

import duckdb
import pytest

from shiftgrid.plans.oracles import ORACLES
from shiftgrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        f = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{f + '/*.parquet' if os.path.isdir(f) else f}') q")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_known_displacement(spark):
    got = QUERIES["multichip_track"](spark, SF).where("dx is not null").collect()
    assert len(got) > 200 and all((r.dx, r.dy) == (-2.0, -1.0) for r in got)


def test_entry_points():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
