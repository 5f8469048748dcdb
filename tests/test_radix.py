"""Radix selection against numpy's quantiles and a fit that really fills."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import prep, radix


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 3000
    special = [0.0, -0.0, 1e308, -1e308, 5e-324, -5e-324, float("inf"), float("-inf"), 1.0, float(np.nextafter(1.0, 2.0))]
    rows = []
    for i in range(n):
        a = float(rng.normal()) if i % 3 else 0.25  # a third of all rows share a value
        b = special[i % len(special)] if i % 7 else None
        c = float("nan") if i % 5 == 0 else (None if i % 4 == 0 else float(np.round(rng.normal(), 1)))
        rows.append((["x", "y", None][i % 3], a, b, c, None))
    return rows, spark.createDataFrame(rows, "g string, a double, b double, c double, none double").repartition(6)


def test_bits_order_like_numbers():
    v = np.array([-np.inf, -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2.0), 1e308, np.inf])
    bits = radix.ordered_bits(v)
    assert (np.diff(bits.astype(object)) > 0).all()
    assert [radix.from_bits(int(b)) for b in bits] == v.tolist()
    assert radix.ordered_bits(np.array([-0.0]))[0] == radix.ordered_bits(np.array([0.0]))[0]


@pytest.mark.parametrize("last", [radix.FINISH, 10, 0])
def test_order_statistics(table, last, monkeypatch):
    monkeypatch.setattr(radix, "FINISH", last)
    rows, df = table
    ranks = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "end": F.col("n") - 1, "beyond": F.col("n"), "before": F.lit(-1), "shift": F.col("n") - 1 - F.col("missing")}
    got = radix.order_stats(df, ["g"], ["a", "b", "c", "none"], ranks)
    assert len(got) == 3 * 4
    for (g,) in {k[0] for k in got}:
        for j, name in enumerate(["a", "b", "c", "none"], 1):
            own = [r[j] for r in rows if r[0] == g]
            v = sorted(x for x in own if x is not None and x == x)
            s = got[(g,), name]
            assert (s["n"], s["missing"]) == (len(v), sum(x is None for x in own))
            at = {"first": 0, "mid": len(v) // 2, "end": len(v) - 1, "beyond": len(v), "before": -1, "shift": len(v) - 1 - s["missing"]}
            assert {k: s[k] for k in at} == {k: (v[i] if 0 <= i < len(v) else None) for k, i in at.items()}


def test_quantiles_interpolate(table):
    rows, df = table
    got = {r.g: r for r in radix.quantiles(df, ["g"], "a", {"q0": 0.0, "q1": 0.013, "q5": 0.5, "q9": 1.0}).collect()}
    for g, r in got.items():
        v = [x[1] for x in rows if x[0] == g]
        assert [r.q0, r.q1, r.q5, r.q9] == pytest.approx(np.quantile(v, [0.0, 0.013, 0.5, 1.0]))


def test_statistics_after_filling_need_no_fill(table):
    rows, df = table
    got = radix.filled_stats(df, ["a", "c", "none"], {"lo": 0.01, "hi": 0.97})
    v = [r[3] for r in rows if r[3] is None or r[3] == r[3]]
    fill = float(np.median([x for x in v if x is not None]))
    full = [fill if x is None else x for x in v]
    for k, q in (("lo", 0.01), ("hi", 0.97)):
        s = got["c"]
        assert s["fill"] == fill and radix.interpolated(s[f"{k}.lo"], s[f"{k}.hi"], s["n"], q) == pytest.approx(np.quantile(full, q))
    assert got["none"]["fill"] == 0.0 and got["none"]["hi.hi"] == 0.0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "g string, a double")
    assert radix.order_stats(empty, ["g"], ["a"], {"r": F.lit(0)}) == {}
    assert radix.quantiles(empty, ["g"], "a", {"q": 0.5}).collect() == []


def test_winsorise_equals_the_step_by_step_fit(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_t(2, 400)
    rows = [(i, None if i % 9 == 0 else float(v), i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, x double, fold int").repartition(3)
    got = {r.i: r.x for r in prep.winsorise(df, df.where("fold <> 0"), ["x"], 0.05, 0.9).collect()}
    train = np.array([np.nan if r[1] is None else r[1] for r in rows if r[2]])
    med = np.nanmedian(train)
    filled = np.where(np.isnan(train), med, train)
    lo, hi = np.quantile(filled, [0.05, 0.9])
    c = np.clip(filled, lo, hi)
    for i, v, _ in rows:
        assert got[i] == pytest.approx((np.clip(med if v is None else v, lo, hi) - c.mean()) / c.std())
