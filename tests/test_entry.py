"""Registered queries against DuckDB on the small tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from semsearch.plans import oracles, queries
from semsearch.streaming import stream

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    result = con.execute(oracles.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 250
    assert set(oracles.oracle_sql()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_appended_searches(spark, tmp_path):
    h = queries.V.history(spark, SF)
    h.write.parquet(str(tmp_path / "in"))
    stream.append_searches(spark.readStream.schema(h.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == h.count()
