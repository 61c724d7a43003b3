"""Trials over which a channel is constant: no correlation, no positive definite covariance, no tangent vector."""

import os
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cohortwave.functions import covariances as cov
from cohortwave.functions import linear
from cohortwave.operators import alignment, covariance, fisher

RNG = np.random.default_rng(12)


@pytest.fixture(scope="module")
def constant(small, tmp_path_factory):
    """The smallest tables, with the tax of some samples of three suppliers set to one value."""
    folder = str(tmp_path_factory.mktemp("constant"))
    for f in os.listdir(small):
        shutil.copy(f"{small}/{f}", folder)
    os.remove(f"{folder}/lineitem.parquet")
    place = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    suppliers = "(SELECT DISTINCT l_suppkey FROM l ORDER BY 1 LIMIT 3)"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW l AS SELECT * FROM '{small}/lineitem.parquet'")
    con.sql(f"COPY (SELECT * EXCLUDE n REPLACE (CASE WHEN n BETWEEN 5 AND 40 AND l_suppkey IN {suppliers} THEN 0.05 ELSE l_tax END AS l_tax) FROM (SELECT *, {place} AS n FROM l)) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return folder


def test_shrunk_covariances_equal_sql(spark, constant):
    got = entry.queries()["cov_ledoit_wolf"](spark, constant)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{constant}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()["cov_ledoit_wolf"]).df()[got.columns]
    cells = lambda rows: Counter(tuple("" if v is None or v != v else float(v) for v in r) for r in rows.itertuples(index=False))
    assert cells(got.toPandas()) == cells(want)
    assert want["c1"].notna().all() and 0 < want["c2"].isna().sum() < len(want)


@pytest.mark.parametrize("name", ["tangent_vectors", "tangent_vectors_mi", "tangent_vectors_whole"])
def test_every_trial_keeps_its_row(spark, small, constant, name):
    rows, before = (entry.queries()[name](spark, folder).toPandas() for folder in (constant, small))
    assert len(rows) == len(before) and before["v"].notna().all()
    assert 0 < rows["v"].isna().sum() < len(rows) and np.isfinite(np.stack(rows["v"].dropna())).all()


@pytest.mark.parametrize("name", ["train_subject", "train_elastic_net", "train_group", "cross_validation", "joint_alignment", "nearest_mean_sets", "group_pipeline", "group_pipeline_corrected", "group_pipeline_mi"])
def test_queries_on_vectors_go_through(spark, small, constant, name):
    got, before = (entry.queries()[name](spark, folder).count() for folder in (constant, small))
    assert got == before > 0


@pytest.mark.parametrize("most", [0, 10_000])
def test_others_have_the_vectors_they_have_without_them(spark, most):
    x = RNG.normal(size=(30, 12, 4))
    rows = [(g, i, 1 + i % 2, None if i % 7 == 3 or g == 2 else cov.pack(cov.scm(x[i] + g)).tolist()) for g in range(3) for i in range(30)]
    frame = spark.createDataFrame(rows, "g int, i int, label int, c array<double>")
    vectors = lambda f: {(r.g, r.i): r.v for r in fisher.tangent_vectors(fisher.class_weights(f, ("g",)), f.groupBy("g").count(), ("g",), ("i", "label"), 4, most=most).collect()}
    got, want = vectors(frame), vectors(frame.where("c is not null"))
    assert len(got) == 90 and {k for k, v in got.items() if v is None} == {(r[0], r[1]) for r in rows if r[3] is None}
    assert all(np.allclose(got[k], v) for k, v in want.items())


def test_singular_covariances_have_no_nearest_mean(spark):
    c = cov.scm(RNG.normal(size=(20, 12, 3)))
    c[3, 2] = c[3, :, 2] = 0
    c[4, 0, 1] = c[4, 1, 0] = np.nan
    assert cov.definite(c).tolist() == [i not in (3, 4) for i in range(20)]
    rows = spark.createDataFrame([(1, i, 1 + i % 2, cov.pack(m).tolist()) for i, m in enumerate(c)], "g int, i int, label int, c array<double>")
    found = fisher.nearest_mean(rows, rows.withColumnRenamed("label", "truth"), ("g",), ("i", "truth"), 3).toPandas()
    assert sorted(found["i"]) == [i for i in range(20) if i not in (3, 4)] and np.isfinite(found["distance"]).all()


def test_classifiers_learn_from_rows_with_vectors(spark):
    v = RNG.normal(size=(40, 3))
    rows = [(1, i, "train" if i < 24 else "test", 1 + i % 2, None if i % 5 == 0 else v[i].tolist()) for i in range(40)]
    rows += [(2, i, "train" if i < 4 else "test", 1, None) for i in range(8)]
    frame = spark.createDataFrame(rows, "domain int, trial_no int, role string, label int, v array<double>")
    got = {r.domain: r.acc for r in alignment.trained_alone(frame, ()).collect()}
    known, label = np.arange(40) % 5 > 0, 1 + np.arange(40) % 2
    train, test = known & (np.arange(40) < 24), known & (np.arange(40) >= 24)
    assert got == {1: linear.balanced_accuracy(label[test], linear.predict(linear.train(v[train], label[train]), v[test])), 2: None}


def test_determinants_of_what_is_known(spark):
    x = RNG.normal(size=(3, 12, 3))
    x[1, :, 1] = 2.0
    frame = spark.createDataFrame([(1, i, 1, m.tolist()) for i, m in enumerate(x)], "recording_id long, trial_no long, class int, x array<array<double>>")
    got = {r.trial_no: np.array(r.c) for r in covariance.estimate(frame, "lw", det=True).collect()}
    assert np.isnan(got[1]).all() and np.allclose(got[2], cov.pack(cov.unit_determinant(cov.ledoit_wolf(x[2:])))[0])
