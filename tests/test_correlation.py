"""Correlations of constant series are null, not an error."""

import datetime as dt

import numpy as np
import pytest

from diurna.functions.numbers import correlation
from diurna.operators.drift import pair_correlations
from diurna.operators.ranking import spearman
from diurna.plans import load_all
from diurna.plans.registry import QUERIES

load_all()


def test_correlation_of_pairs(spark):
    rows = [("flat", 1.0, float(i)) for i in range(4)] + [("one", 1.0, 2.0), ("none", None, 2.0)]
    rows += [("gap", x, y) for x, y in ((1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 100.0), (4.0, 4.0))]
    got = {r.g: r.r for r in spark.createDataFrame(rows, "g string, x double, y double").groupBy("g").agg(correlation("x", "y").alias("r")).collect()}
    assert got["flat"] is None and got["one"] is None and got["none"] is None
    assert got["gap"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])


def test_constant_ranks_and_columns(spark):
    d = spark.createDataFrame([("a", 1.0, float(i), float(i * i)) for i in range(5)], "g string, x double, y double, z double")
    assert [(r.rho, r.n) for r in spearman(d, ["g"], "x", "y").collect()] == [(None, 5)]
    assert {(r.a, r.b): r.r is None for r in pair_correlations(d, ["x", "y", "z"]).collect()} == {("x", "y"): True, ("x", "z"): True, ("y", "z"): False}


def test_lag1_of_a_constant_series(spark, tmp_path):
    days = [(u, dt.datetime(2024, 1, 1 + k, 5), "click", 3.0 if u == 1 else float(k * k % 7)) for u in (1, 2) for k in range(14)]
    rows = [(i, ts, u, kind, v, "{}") for i, (u, ts, kind, v) in enumerate(days)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.subject_id, r.channel): (r.n_pairs, r.r) for r in QUERIES["lag1_consecutive_corr"](spark, str(tmp_path)).collect()}
    v = [k * k % 7 for k in range(14)]
    assert got[("1", "v_max")] == (13, None)
    assert got[("2", "v_max")] == (13, pytest.approx(np.corrcoef(v[:-1], v[1:])[0, 1], abs=1e-6))
