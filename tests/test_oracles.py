"""Every raster query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from conftest import DATA
from rasterloom import raster_queries, raster_sql

SF = DATA / "sf0.001"
SQL = raster_sql.oracle_sql()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = raster_queries.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())
    assert len(found.description) == len(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(raster_queries.NAMES) - set(SQL)))
def test_runs(spark, name):
    assert raster_queries.queries()[name](spark, str(SF)).count() > 0


def test_partitions_do_not_matter(spark):
    results = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, raster_queries.queries()["q19_objective"](spark, str(SF)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]
