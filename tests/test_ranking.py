"""Order statistics, neighbours and hash orders against numpy on skewed data."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna.operators import drift as D
from diurna.operators import metrics as M
from diurna.operators import neighbours as N
from diurna.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.round(rng.gamma(2, 10, 3000), 1)] + [("hot", 7.0)] * 2000
    rows += [("cold", float(v)) for v in rng.normal(size=37)] + [("one", 4.0), ("cold", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4).cache()


def test_quantiles(skewed):
    got = R.quantiles(skewed, ["g"], "v", [0.0, 0.01, 0.5, 0.975, 1.0], ranges=8).toPandas().set_index("g")
    pdf = skewed.toPandas().dropna()
    for g, x in pdf.groupby("g").v:
        np.testing.assert_allclose(got.loc[g, ["q0", "q1", "q50", "q97_5", "q100"]].astype(float), np.quantile(x, [0, 0.01, 0.5, 0.975, 1]), rtol=1e-12)


def test_many_groups_over_many_partitions(spark):
    """Ranges must be the same in every branch of the plan, also for several mid-sized groups."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 6, 12000), "v": rng.normal(size=12000)})
    d = spark.createDataFrame(pdf).repartition(16)
    want = pdf.groupby("g").v.quantile([0.1, 0.5, 0.9]).unstack()
    for _ in range(3):
        got = R.quantiles(d, ["g"], "v", [0.1, 0.5, 0.9]).toPandas().set_index("g").sort_index()
        np.testing.assert_allclose(got[["q10", "q50", "q90"]], want, rtol=1e-12)


def test_midranks(skewed):
    got = R.midranks(skewed, ["g"], "v", ranges=8).toPandas()
    pdf = skewed.toPandas().dropna()
    pdf["want"] = pdf.groupby("g").v.rank()
    m = got.merge(pdf.drop_duplicates(["g", "v"]), on=["g", "v"])
    assert len(m) == len(got)
    np.testing.assert_allclose(m.midrank, m.want)


def test_ordinal_is_a_dense_hash_order(spark):
    d = spark.range(5000).select(F.col("id").cast("string").alias("s")).withColumn("h", F.md5("s"))
    got = R.ordinal(d, [], "h", "s").orderBy("idx").toPandas()
    assert list(got.idx) == list(range(5000))
    assert list(got.h) == sorted(got.h)
    assert got.h[0] == min(hashlib.md5(str(i).encode()).hexdigest() for i in range(5000))


def brute(q, r, k, skip):
    out = {}
    for i, x in q.items():
        d = sorted((float(np.linalg.norm(x - y)), j) for j, y in r.items() if not (skip and i == j))
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("block,pivots", [(1024, 64), (40, 6)])
def test_nearest_is_exact(spark, block, pivots):
    """The pruned path (several cells, crowded cell split into blocks) equals brute force."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.01, (150, 3)), rng.normal(0, 5, (100, 3))])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(len(x)))
    df = spark.createDataFrame(pdf)
    got = N.nearest(df, df, ["a", "b", "c"], 4, "id", "id", skip_self=True, block=block, pivots=pivots).toPandas()
    pts = {int(i): v for i, v in zip(pdf.id, x)}
    want = brute(pts, pts, 4, True)
    for i, g in got.sort_values("rank").groupby("qid"):
        assert list(g.rid) == want[i]
    assert got.qid.nunique() == len(x)


def test_auc_ties_and_one_class(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    rows = [("m", int(a), float(b)) for a, b in zip(y, s)] + [("single", 1, 0.3), ("single", 1, 0.4)]
    got = {r.g: r.auc for r in M.roc_auc(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "s", "y").collect()}
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert got["m"] == pytest.approx(want, abs=1e-12)
    assert got["single"] is None


def test_ks_of_identical_sides_is_zero(spark):
    rows = [("f", float(v), side) for v in range(50) for side in (0, 1)]
    d = spark.createDataFrame(rows, "feature string, value double, side int")
    assert D.ks(d, "feature", "value", "side").first().ks == 0
    assert D.wasserstein(d, "feature", "value", "side").first().wasserstein == 0
