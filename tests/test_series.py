"""Known-answer and numpy comparisons for array expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.functions import series as S
from diurna.operators import intraday as I
from diurna.operators import subject as U


def value(spark, arr, expr, typ="array<double>"):
    return spark.createDataFrame([(arr,)], f"a {typ}").select(expr(F.col("a")).alias("r")).first().r


def close(a, b):
    assert a == pytest.approx(b, abs=1e-9), (a, b)


@pytest.mark.parametrize("text,keep,drop", [
    ("1.5/2/3/", [1.5, 2.0, 3.0], [1.5, 2.0, 3.0]), ("1,2", [1.0, 2.0], [1.0, 2.0]), ("1/x/3", [1.0, None, 3.0], [1.0, 3.0]),
    ("...", [], []), ("nan", [], []), ("", [], []), ("1/nan/inf/2", [1.0, None, None, 2.0], [1.0, 2.0])])
def test_parse(spark, text, keep, drop):
    r = spark.createDataFrame([(text,)], "t string").select(
        I.parse_series(F.col("t")).alias("k"), I.parse_series(F.col("t"), False).alias("d")).first()
    assert r.k == keep and r.d == drop


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 40):
        x = np.round(rng.normal(5, 3, n), 3)
        a = [float(v) for v in x] + [None]
        z = (x - x.mean()) / x.std() if x.std() > 0 else x * 0
        close(value(spark, a, S.mean), x.mean())
        close(value(spark, a, S.sd), x.std())
        if n > 2:
            close(value(spark, a, S.skewness), (z ** 3).mean())
            close(value(spark, a, S.kurtosis), (z ** 4).mean() - 3)
            close(value(spark, a, S.slope), np.polyfit(np.arange(n), x, 1)[0])
        close(value(spark, a, S.median), np.median(x))
        close(value(spark, a, lambda c: S.quantile(S.ordered(c), 0.9)), np.quantile(x, 0.9))


def test_constant_and_empty(spark):
    assert value(spark, [], S.mean) is None
    assert value(spark, [2.0, 2.0, 2.0], S.skewness) is None
    assert value(spark, [2.0, 2.0, 2.0], lambda c: S.histogram_entropy(c, 16)) is None
    assert value(spark, [None, None], S.interpolate) is None
    assert value(spark, [], lambda c: S.longest_run(c, lambda x: x > 0)) == 0


def test_runs_and_interpolation(spark):
    lengths = value(spark, [1.0, 1.0, 2.0, None, None, 2.0], lambda c: S.run_lengths(c, lambda x: x >= 1))
    assert lengths == [3, 1]
    assert value(spark, [None, 1.0, None, 3.0, None], S.interpolate) == [1.0, 1.0, 2.0, 3.0, 3.0]
    wrapped = value(spark, [None, 1.0, 2.0, 4.0], lambda c: S.circular_interpolate(c, 3))
    close(wrapped[0], 2.5)


def test_cosinor_recovers_rhythm(spark):
    hours = [i / 60 for i in range(0, 1440, 7)]
    y = [2.0 + 1.5 * math.cos(2 * math.pi * (h - 15) / 24) for h in hours]
    r = spark.createDataFrame([(y, hours)], "y array<double>, h array<double>").select(S.cosinor(F.col("y"), F.col("h")).alias("c")).first().c
    close(r.mesor, 2.0)
    close(r.amplitude, 1.5)
    close(math.atan2(r.sin_coef, r.cos_coef) % (2 * math.pi) * 24 / (2 * math.pi), 15.0)


def test_spectrum_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=24)
    amp = value(spark, [float(v) for v in x], lambda c: S.amplitudes(c, F.sequence(F.lit(1), F.lit(12))))
    np.testing.assert_allclose(amp, np.abs(np.fft.rfft(x))[1:], atol=1e-9)


def test_densify_and_array_split(spark):
    r = spark.createDataFrame([([1, 4], [5.0, 6.0])], "p array<int>, v array<double>").select(S.densify(F.col("p"), F.col("v"), 6).alias("d")).first().d
    assert r == [None, 5.0, None, None, 6.0, None]
    parts = value(spark, [float(i) for i in range(10)], lambda c: U.array_split(c, 4))
    assert [len(p) for p in parts] == [len(p) for p in np.array_split(np.arange(10), 4)]


def test_wake_window_and_bouts(spark):
    minutes = list(range(1440))
    vals = [2.0 if 300 <= m < 360 or 900 <= m < 960 else 1.0 for m in minutes]
    d = spark.createDataFrame([("s", "d", minutes, vals)], "subject_id string, date string, mins array<int>, vals array<double>")
    r = I.wake_windows(d, ["subject_id", "date"], "mins", "vals", 1.5).first()
    assert (r.onset, r.offset_minute) == (285, 975)  # 15 active minutes of 30 reach the mean of 1.5
    assert (r.sed_total, r.sed_longest, r.sed_n) == (570, 540, 3)


def test_window_extrema(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(2, 1, 1440), 2)
    d = spark.createDataFrame([("s", list(range(1440)), [float(v) for v in x])], "k string, mins array<int>, vals array<double>")
    r = I.window_extrema(d, ["k"], "mins", "vals").first()
    c = np.concatenate([[0], np.cumsum(x)])
    w10, w5 = (c[600:] - c[:-600]) / 600, (c[300:] - c[:-300]) / 300
    close(r.m10, w10.max())
    close(r.l5, w5.min())
    assert (r.m10_start, r.l5_start) == (w10.argmax(), w5.argmin())
