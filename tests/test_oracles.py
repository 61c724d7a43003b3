"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from cohortwave.jobs import alignment_queries, scan_queries, signal_queries, stream_queries, tomography_queries

SQL = signal_queries.ORACLE_SQL | scan_queries.ORACLE_SQL | tomography_queries.ORACLE_SQL | alignment_queries.ORACLE_SQL | stream_queries.ORACLE_SQL


def _cell(v):
    if v is None or v != v:
        return ""
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    got = entry.queries()[name](spark, small)
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    have = got.select(columns).toPandas()
    assert Counter(tuple(map(_cell, r)) for r in have.itertuples(index=False)) == Counter(tuple(map(_cell, r)) for r in want[columns].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).columns == ["recording_id", "class", "dt", "channel", "mean"]


def test_every_query_is_callable_and_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_standardise_returns_the_stimuli_beside_every_sample(spark, small, con):
    want = Counter((r.recording_id, r.t, r.stim) for r in signal_queries.line_samples(spark, small).collect())
    got = entry.queries()["standardise"](spark, small)
    assert Counter((r.recording_id, r.t, r.stim) for r in got.collect()) == want and len({k[2] for k in want}) == 3
    assert con.sql(entry.oracle_sql()["standardise"]).columns == got.columns == ["recording_id", "t", "stim", "x1", "x2", "x3", "x4"]
