"""Neighbours and donors inside a task against plain double precision, and the plan around them."""

import numpy as np
import pyarrow as pa
import pytest

from diurna.operators import neighbours as N


def table(name, ids, x):
    return pa.table({f"{name}id": pa.array(ids, pa.int64()), f"{name}x": pa.array([[None if v != v else v for v in row] for row in x.tolist()], pa.list_(pa.float64()))})


def data(kind, rng):
    a, b = rng.normal(size=(70, 9)), rng.normal(size=(700, 9))
    if kind == "copies":
        b = np.repeat(b[:20], 35, axis=0)
        a = b[::10].copy()
    if kind == "far":  # a large offset and one outlier
        a, b = a * 1e-3 + 1e6, b * 1e-3 + 1e6
        b[5] = 1e9
    if kind == "tiny":
        a, b = a * 1e-40, b * 1e-40
        b[7] = 1.0
    if kind == "huge":
        b[3], a[2] = 1e200, -1e200
    return a, b


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "tiny", "huge"])
@pytest.mark.parametrize("skip", [False, True])
def test_nearest_in_a_block(kind, skip):
    a, b = data(kind, np.random.default_rng(1))
    rid = np.random.default_rng(2).permutation(len(b))
    qid = np.arange(len(a)) * 3
    got = N._best(4, skip)(table("q", qid, a), table("r", rid, b)).to_pylist()
    want = []
    with np.errstate(over="ignore"):
        for i, x in zip(qid, a):
            d = np.sqrt(((x[None, None] - b[None]) ** 2).sum(axis=2))[0]
            want += [{"qid": i, "rid": j, "dist": v} for v, j in sorted((v, j) for v, j in zip(d, rid) if np.isfinite(v) and not (skip and i == j))[:4]]
    assert got == want


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "tiny", "huge"])
def test_donors_in_a_block(kind):
    rng = np.random.default_rng(3)
    a, b = data(kind, rng)
    a[rng.random(a.shape) < 0.2] = np.nan
    b[rng.random(b.shape) < 0.2] = np.nan
    b[11] = np.nan
    b[12, 0] = np.inf
    a[0, 1:] = np.nan
    rid = np.random.default_rng(2).permutation(len(b))
    got = N._donors(3)(table("q", range(len(a)), a), table("r", rid, b)).to_pylist()
    want = []
    with np.errstate(over="ignore", invalid="ignore"):
        for i, x in enumerate(a):
            both = ~np.isnan(x)[None] & ~np.isnan(b)
            n = both.sum(axis=1)
            d = np.where(n > 0, np.sqrt(np.where(both, (b - x) ** 2, 0.0).sum(axis=1) * 9 / np.maximum(n, 1)), np.inf)
            for f in np.flatnonzero(np.isnan(x)):
                best = sorted((v, j, y) for v, j, y in zip(d, rid, b[:, f]) if np.isfinite(v) and y == y)[:3]
                want += [{"qid": i, "feature": f, "rid": j, "dist": v, "value": y} for v, j, y in best]
    assert got == want


def test_rows_without_finite_values_do_not_hide_a_cell(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(200, 2)))] + [(900, float("nan"), 1.0), (901, None, 2.0), (902, float("inf"), 0.0)]
    d = spark.createDataFrame(rows, "id bigint, a double, b double")
    got = {(r.qid, r.rid) for r in N.nearest(d, d, ["a", "b"], 1, "id", "id", skip_self=True, block=20, pivots=4).collect()}
    x = np.array([r[1:] for r in rows[:200]])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag(np.full(200, np.inf))
    assert got == set(enumerate(dist.argmin(axis=1).tolist()))


def test_block_counts_are_broadcast_and_rows_are_not(spark, tmp_path):
    spark.range(3000).selectExpr("id", "double(id) as a", "double(id % 7) as b").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    plan = N.nearest(d, d, ["a", "b"], 2, "id", "id", block=500, pivots=8)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan


def test_copies_exchanged_follow_the_rows(spark):
    """A row goes to a bounded number of pairs of blocks, not to one for every thousand rows."""
    q = spark.range(40000).selectExpr("id as qid", "array(double(id)) as qx")
    r = spark.range(40000).selectExpr("id as rid", "array(double(id)) as rx")
    n = N._pair_blocks(q, r, [], N.BLOCK).applyInArrow(lambda a, b: pa.table({"n": [len(a) + len(b)]}), "n bigint").groupBy().sum("n").first()[0]
    assert n <= 40000 * (2 + 16)
