"""Registered queries against DuckDB, and streams against their batch form."""

import math

import duckdb
import pytest

import __spark_entry__
from fieldtrust import queries
from fieldtrust.sources.testbed import TABLES
from fieldtrust.streaming import monitor

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def one(v):
        if isinstance(v, float) and not math.isnan(v):
            return repr(round(v, 9) + 0.0)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    found = oracle.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 9000


def test_stream_equals_batch(spark, tmp_path):
    batch = monitor.review_rate(spark.read.parquet(f"{SF}/events.parquet"), 50.0)
    stream = monitor.review_rate(monitor.read_events(spark, f"{SF}/events.parquet*"), 50.0)
    got = monitor.drain(stream, "review_rate", str(tmp_path / "c"))
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(got) == key(batch) and batch.count() > 0
