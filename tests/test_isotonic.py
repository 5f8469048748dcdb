"""Isotonic fits from hulls against pooling on one list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators.isotonic import isotonic, isotonic_blocks


def pooled(rows):
    """[low, high, weight, sum] of the rising fit."""
    blocks = []
    for x in sorted({s for s, _ in rows}):
        ys = [y for s, y in rows if s == x]
        blocks.append([x, x, len(ys), sum(ys)])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return blocks


def predicted(blocks, x):
    if not blocks:
        return None
    xs = [v for b in blocks for v in ((b[0], b[1]) if b[0] < b[1] else (b[0],))]
    vs = [b[3] / b[2] for b in blocks for _ in range(2 if b[0] < b[1] else 1)]
    return float(np.interp(x, xs, vs))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in ("a", "b", None):
        for i in range(500):
            s = 0.5 if i % 3 == 0 else float(np.round(rng.random(), 2 if g == "a" else 6))
            rows.append((g, s, int(rng.random() < (s if g != "b" else 1 - s))))
    rows += [("up", i / 50, int(i > 20)) for i in range(50)] + [("one", 0.3, 1)]
    extra = [("a", None, 1), ("a", float("nan"), 0), ("b", 0.2, None)]
    return rows, spark.createDataFrame(rows + extra, "g string, score double, y int").repartition(6)


@pytest.mark.parametrize(("per_range", "most"), [(4096, 512), (20, 512), (5, 100), (10, 3)])
def test_blocks_equal_pooling(table, per_range, most):
    rows, df = table
    got = isotonic_blocks(df, ["g"], "score", "y", per_range, most).collect()
    for g in {r[0] for r in rows}:
        want = [(b[0], b[1], b[2], b[3] / b[2]) for b in pooled([r[1:] for r in rows if r[0] == g])]
        own = sorted((r.low, r.high, r.w, r.value) for r in got if r.g == g)
        assert len(own) == len(want) and np.allclose(own, want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("per_range", [4096, 15])
def test_values_are_linear_between_blocks(spark, table, per_range):
    rows, df = table
    rng = np.random.default_rng(1)
    asked = [(i, g, s) for g in ("a", "b", "up", "one", None, "new") for i, s in enumerate([-1.0, 0.0, 0.3, 0.5, 2.0, *rng.random(60).tolist(), *[0.5] * 40])] + [(0, "a", None), (0, "a", float("nan"))]
    test = spark.createDataFrame(asked, "i int, g string, score double").repartition(3)
    got = isotonic(df, test, "score", "y", ["g"], per_range).collect()
    assert len(got) == len(asked)
    fits = {g: pooled([r[1:] for r in rows if r[0] == g]) for g in {r[0] for r in rows}}
    for r in got:
        if r.score is None or r.score != r.score or r.g == "new":
            assert r.calibrated is None
        else:
            assert r.calibrated == pytest.approx(predicted(fits[r.g], r.score))


def test_without_a_key_and_without_rows(spark, table):
    rows, df = table
    one = df.where("g = 'a'").drop("g")
    got = {r.score: r.calibrated for r in isotonic(one, one.select("score").where("score > 0"), "score", "y").collect() if r.score == r.score}
    fit = pooled([r[1:] for r in rows if r[0] == "a"])
    assert got == pytest.approx({s: predicted(fit, s) for s in got})
    assert isotonic(one.limit(0), one.limit(0), "score", "y").collect() == []
    assert {r.calibrated for r in isotonic(one.limit(0), one.limit(5).withColumn("z", F.lit(1)), "score", "y").collect()} == {None}
