"""Resampling inference, multiple testing and classical tests from grouped moments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from diurna.operators.draws import auc_draws, permutation_auc
from diurna.operators.metrics import roc_auc
from diurna.operators.ranking import one_row
from diurna.sources.files import materialise

DRAWS, PERMUTATIONS = 2000, 1000


def interval(draws: DataFrame, key, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval; a group holds one row per draw."""
    p = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return draws.groupBy(*key).agg(F.count(value).alias("n_draws"), p.alias("_p")).select(
        *key, "n_draws", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def bootstrap_ci(scores: DataFrame, subject: str, score: str, label: str, key, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """AUC with a percentile interval over Poisson bootstrap draws of the subjects; draws without one of the classes do not count."""
    ci = interval(auc_draws(scores, key, subject, score, label, draws, seed).where("auc is not null"), key, "auc")
    return roc_auc(scores, key, score, label).select(*key, "auc").join(ci, list(key))


def paired_difference(scores: DataFrame, subject: str, score: str, label: str, model: str, a: str, b: str, key, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Interval of AUC(a) - AUC(b) over shared draws."""
    def diff(d, keys):
        return d.groupBy(*keys).agg((F.max(F.when(F.col(model) == a, F.col("auc"))) - F.max(F.when(F.col(model) == b, F.col("auc")))).alias("diff"))

    obs = diff(roc_auc(scores, [*key, model], score, label), key).withColumnRenamed("diff", "observed")
    dr = diff(auc_draws(scores, [*key, model], subject, score, label, draws, seed), [*key, "draw"]).where("diff is not null")
    return obs.join(interval(dr, key, "diff"), list(key))


def hanley_mcneil(auc: Column, n1: Column, n0: Column, z: float = 1.96) -> dict[str, Column]:
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    v = (auc * (1 - auc) + (n1 - 1) * (q1 - auc * auc) + (n0 - 1) * (q2 - auc * auc)) / (n1 * n0)
    se = F.sqrt(F.greatest(v, F.lit(0.0)))
    a = F.greatest(F.least(auc, F.lit(1 - 1e-6)), F.lit(1e-6))
    logit, sl = F.log(a / (1 - a)), se / (a * (1 - a))
    return {"se": se, "wald_low": auc - z * se, "wald_high": auc + z * se,
            "logit_low": 1 / (1 + F.exp(-(logit - z * sl))), "logit_high": 1 / (1 + F.exp(-(logit + z * sl)))}


def variability(df: DataFrame, key, value: str) -> DataFrame:
    """Mean with a 95 percent t interval; the quantile is exact for every number of degrees of freedom."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    g = df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    half = t_quantile(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    return g.withColumn("_half", half).select(*key, "n", "mean", "sd", "min", "max", (F.col("mean") - F.col("_half")).alias("t_low"), (F.col("mean") + F.col("_half")).alias("t_high"))


def permutation_p(null: DataFrame, observed: DataFrame, key, value: str) -> DataFrame:
    """Per key (1 + #null >= observed) / (n + 1) and null percentiles; one row per permutation and one observed row go in."""
    key = list(key)
    obs = observed.select(*key, F.col(value).alias("observed"))
    j = null.join(obs, key) if key else null.transform(one_row, obs)
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return j.groupBy(*key, "observed").agg(
        F.count(value).alias("n"), ((F.count(F.when(F.col(value) >= F.col("observed"), 1)) + 1) / (F.count(value) + 1)).alias("p"),
        F.avg(value).alias("null_mean"), p.alias("_p")).select(*key, "observed", "n", "p", "null_mean", F.col("_p")[0].alias("null_median"), F.col("_p")[1].alias("null_p95"))


def permutation_test(scores: DataFrame, key, subject: str, score: str, label: str, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """p value of each key's AUC under permutation of the subjects' labels; at least 1 / (permutations + 1)."""
    return permutation_p(permutation_auc(scores, key, subject, score, label, permutations, seed), roc_auc(scores, key, score, label), key, "auc")


def holm(df: DataFrame, name: str, p: str, family=()) -> DataFrame:
    """Step-down adjustment inside a family of hypotheses (bounded by the feature list)."""
    part = [F.col(c) for c in family] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(p, name)
    m, i = F.count("*").over(Window.partitionBy(*part)), F.row_number().over(w) - 1
    d = df.withColumn("_s", (m - i) * F.col(p))
    return d.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def bh(df: DataFrame, name: str, p: str, family=()) -> DataFrame:
    part = [F.col(c) for c in family] or [F.lit(0)]
    m = F.count("*").over(Window.partitionBy(*part))
    r = F.row_number().over(Window.partitionBy(*part).orderBy(p, name))
    d = df.withColumn("_q", F.col(p) * m / r)
    w = Window.partitionBy(*part).orderBy(F.col(p).desc(), F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("q", F.least(F.lit(1.0), F.min("_q").over(w))).drop("_q")


def winner_bias(scores: DataFrame, subject: str, score: str, label: str, candidate: str, base: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """mean over draws of the best candidate's gain minus the best observed gain."""
    def best(d, keys):
        part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per candidate
        gain = d.withColumn("_g", F.col("auc") - F.max(F.when(F.col(candidate) == base, F.col("auc"))).over(part)).where(F.col(candidate) != base)
        return gain.groupBy(*keys).agg(F.max("_g").alias("gain"))

    obs = best(roc_auc(scores, [candidate], score, label), []).withColumnRenamed("gain", "observed_max")
    dr = best(auc_draws(scores, [candidate], subject, score, label, draws, seed), ["draw"]).agg(F.avg("gain").alias("mean_max"), F.count("gain").alias("n_draws"))
    return dr.transform(one_row, obs).withColumn("bias", F.col("mean_max") - F.col("observed_max"))


def macro_f1(conf: Column, k: int = 3) -> Column:
    """Macro F1 of a flat k x k count array (truth-major)."""
    def at(i, j):
        return F.get(conf, F.lit(i * k + j))

    total = F.lit(0.0)
    for c in range(k):
        row, col = sum((at(c, j) for j in range(1, k)), at(c, 0)), sum((at(i, c) for i in range(1, k)), at(0, c))
        total = total + F.coalesce(F.try_divide(2.0 * at(c, c), row + col), F.lit(0.0))
    return total / k


def leave_out_deltas(df: DataFrame, truth: str, pred_a: str, pred_b: str, k: int = 3) -> DataFrame:
    """Macro-F1 difference of two predictors with every subject, and every pair, removed.

    Subjects with the same (truth, a, b) give the same result, so the k^3 cells stand for all
    subjects and all pairs exactly; no pair of subjects is ever formed.
    """
    cells = df.groupBy(truth, pred_a, pred_b).agg(F.count("*").alias("n")).select(
        (F.col(truth) * k + F.col(pred_a)).cast("int").alias("ia"), (F.col(truth) * k + F.col(pred_b)).cast("int").alias("ib"), "n")

    def matrix(ix):
        return F.array(*[F.sum(F.when(F.col(ix) == i, F.col("n")).otherwise(0)) for i in range(k * k)])

    totals = cells.agg(matrix("ia").alias("ca"), matrix("ib").alias("cb"))

    def minus(conf, *ix):
        return F.transform(conf, lambda x, i: x - sum((F.when(i == F.col(c), 1).otherwise(0) for c in ix[1:]), F.when(i == F.col(ix[0]), 1).otherwise(0)))

    one = cells.transform(one_row, totals).select(
        F.lit(1).alias("removed"), F.col("n").alias("times"), (macro_f1(minus(F.col("ca"), "ia")) - macro_f1(minus(F.col("cb"), "ib"))).alias("delta"))
    other = cells.select(F.col("ia").alias("ja"), F.col("ib").alias("jb"), F.col("n").alias("m"))
    # at most k^3 x k^3 cell pairs, whatever the data size
    pairs = cells.join(other, (F.col("ia") * 100 + F.col("ib")) <= (F.col("ja") * 100 + F.col("jb")))
    times = F.when((F.col("ia") == F.col("ja")) & (F.col("ib") == F.col("jb")), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("m"))
    two = pairs.transform(one_row, totals).select(
        F.lit(2).alias("removed"), times.cast("bigint").alias("times"),
        (macro_f1(minus(F.col("ca"), "ia", "ja")) - macro_f1(minus(F.col("cb"), "ib", "jb"))).alias("delta")).where("times > 0")
    return one.unionByName(two).groupBy("removed").agg(
        F.sum("times").alias("evaluations"), (F.sum(F.when(F.col("delta") > 0, F.col("times")).otherwise(0)) / F.sum("times")).alias("positive_fraction"),
        F.min("delta").alias("min_delta"))


def welch(long: DataFrame, key, group: str, value: str, min_n: int = 10) -> DataFrame:
    """Welch t and degrees of freedom of group 1 against group 0, from one pass of moments."""
    def m(f, g):
        return f(F.when(F.col(group) == g, F.col(value)))

    g = long.groupBy(*key).agg(*[e for i in (0, 1) for e in (
        m(F.count, i).alias(f"n{i}"), m(F.avg, i).alias(f"m{i}"), m(F.var_samp, i).alias(f"v{i}"))])
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    ok = (F.col("n0") >= min_n) & (F.col("n1") >= min_n) & (a + b > 0)
    return g.select(*key, "n0", "n1", F.when(ok, (F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"),
                    F.when(ok, (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))).alias("df"))


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by numerical quadrature, for the t tail only."""
    u, w = np.polynomial.legendre.leggauss(200)
    out = np.empty_like(x)
    for i, (ai, xi) in enumerate(zip(a, x)):
        # t = xi * s^2 tames the end points for b = 1/2 after 1 - t = c^2
        hi = np.arcsin(np.sqrt(xi))
        th = 0.5 * hi * (u + 1)
        f = np.sin(th) ** (2 * ai - 1) * np.cos(th) ** (2 * b - 1)
        part = 0.5 * hi * np.dot(w, f)
        th = 0.25 * np.pi * (u + 1)
        out[i] = part / (0.25 * np.pi * np.dot(w, np.sin(th) ** (2 * ai - 1) * np.cos(th) ** (2 * b - 1)))
    return out


@F.pandas_udf(DoubleType())
def two_sided_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t; Arrow-batched."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        tt, dd = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = _incomplete_beta(dd / 2, 0.5, dd / (dd + tt * tt))
    return out


@F.pandas_udf(DoubleType())
def t_quantile(q: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of Student's t by bisection of its tail; Arrow-batched, null below one degree of freedom."""
    ok = q.notna() & df.notna() & (df >= 1)
    out = pd.Series(np.nan, index=q.index)
    if ok.any():
        qq, dd = q[ok].to_numpy(float), df[ok].to_numpy(float)
        tail = 2 * np.minimum(qq, 1 - qq)
        low, high = np.zeros_like(dd), np.full_like(dd, 1.0)
        for _ in range(60):  # widen until the tail beyond is small enough
            wide = _incomplete_beta(dd / 2, 0.5, dd / (dd + high * high)) > tail
            if not wide.any():
                break
            high[wide] *= 2
        for _ in range(60):
            mid = (low + high) / 2
            more = _incomplete_beta(dd / 2, 0.5, dd / (dd + mid * mid)) > tail
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        out[ok] = np.where(qq < 0.5, -1, 1) * (low + high) / 2
    return out


def one_sample_t(df: DataFrame, key, value: str, group: str, reference: int, tested: int) -> DataFrame:
    """t of the tested group's mean against the reference group's mean."""
    ref = F.avg(F.when(F.col(group) == reference, F.col(value)))
    x = F.when(F.col(group) == tested, F.col(value))
    g = df.groupBy(*key).agg(ref.alias("reference_mean"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return g.withColumn("t", F.try_divide(F.col("mean") - F.col("reference_mean"), F.col("sd") / F.sqrt("n")))


def intercept_cells(df: DataFrame, subject: str, group: str, value: str) -> DataFrame:
    """Subjects of equal (n, x) as one row: how many, and the sums of their means, squared means and inner squares.

    A subject enters the likelihood only through its n, its x and these, so a table with as many
    rows as there are distinct counts stands for all subjects. Means are taken from the overall mean.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isNotNull())
    per = d.groupBy(subject).agg(F.max(group).cast("double").alias("x"), F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    per = materialise(per, "subjects")
    centre = per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_c"))
    return per.transform(one_row, centre).withColumn("m", F.col("m") - F.col("_c")).groupBy("n", "x").agg(
        F.count("*").cast("double").alias("k"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("v")).alias("ss"), F.first("_c").alias("centre"))


def restricted_likelihood(cells: DataFrame, ratio: float) -> dict[str, float] | None:
    """The restricted likelihood at a variance ratio with its first two derivatives; one aggregation over the cells."""
    w = F.col("n") / (1 + F.lit(float(ratio)) * F.col("n"))
    terms = {"": F.col("k"), "x": F.col("k") * F.col("x"), "xx": F.col("k") * F.col("x") * F.col("x"), "m": F.col("sm"), "xm": F.col("x") * F.col("sm"), "mm": F.col("smm")}
    sums = [F.sum(F.pow(w, F.lit(p)) * t).alias(f"s{p}{name}") for p in (1, 2, 3) for name, t in terms.items()]
    s = cells.agg(*sums, F.sum("ss").alias("ss"), F.sum(F.col("k") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.log(1 + F.lit(float(ratio)) * F.col("n"))).alias("ld"), F.first("centre").alias("centre")).first()
    if s.nn is None or s.nn <= 2:
        return None
    det = s.s1 * s.s1xx - s.s1x ** 2
    if not det > 1e-12 * s.s1 * max(s.s1xx, 1e-300):
        return None  # one group only
    b1 = (s.s1 * s.s1xm - s.s1x * s.s1m) / det
    b0 = (s.s1xx * s.s1m - s.s1x * s.s1xm) / det
    rss = s.ss + s.s1mm - b0 * s.s1m - b1 * s.s1xm
    if not rss > 0:
        return None  # the model leaves nothing

    def squares(p: int) -> float:  # weighted squares of the subjects' residuals
        g = {k: s[f"s{p}{k}"] for k in terms}
        return g["mm"] - 2 * b0 * g["m"] - 2 * b1 * g["xm"] + b0 * b0 * g[""] + 2 * b0 * b1 * g["x"] + b1 * b1 * g["xx"]

    inverse = np.array([[s.s1xx, -s.s1x], [-s.s1x, s.s1]]) / det
    second, third = (np.array([[s[f"s{p}"], s[f"s{p}x"]], [s[f"s{p}x"], s[f"s{p}xx"]]]) for p in (2, 3))
    h = np.array([s.s2m - b0 * s.s2 - b1 * s.s2x, s.s2xm - b0 * s.s2x - b1 * s.s2xx])
    d1, d2 = -squares(2), 2 * squares(3) - 2 * float(h @ inverse @ h)
    free, ab = s.nn - 2, inverse @ second
    slope = -0.5 * (free * d1 / rss + s.s1 - np.trace(ab))
    curve = -0.5 * (free * (d2 / rss - (d1 / rss) ** 2) - s.s2 - np.trace(ab @ ab) + 2 * np.trace(inverse @ third))
    sigma2 = rss / free
    return {"ratio": float(ratio), "beta": b1, "se": math.sqrt(sigma2 * s.s1 / det), "sigma2": sigma2, "nn": s.nn, "slope": float(slope), "curve": float(curve),
            "criterion": -0.5 * (free * math.log(sigma2) + s.ld + math.log(det))}


def random_intercept(df: DataFrame, subject: str, group: str, value: str, tolerance: float = 1e-10, steps: int = 100) -> DataFrame:
    """value ~ group with a random intercept per subject: one row with the REML fit and the two-sided normal p of its slope.

    Safeguarded Newton search for the ratio of the variances: the optimum is kept between a rising
    and a falling point, a step that leaves them or meets the wrong curvature becomes a bisection.
    Ratio 0 if the likelihood falls from there. No row when there is one group or nothing to explain.
    """
    cells = materialise(intercept_cells(df, subject, group, value), "cells")
    at = restricted_likelihood(cells, 0.0)
    if at is not None and at["slope"] > 0:
        low, high = 0.0, 1.0
        while (at := restricted_likelihood(cells, high))["slope"] > 0 and high < 1e12:
            low, high = high, high * 8
        for _ in range(steps):
            x = at["ratio"]
            if at["slope"] > 0:
                low = x
            else:
                high = x
            step = x - at["slope"] / at["curve"] if at["curve"] < 0 else math.nan
            new = step if low < step < high else (low + high) / 2
            if abs(new - x) <= tolerance * max(x, 1e-300) or high - low <= tolerance * high:
                break
            at = restricted_likelihood(cells, new)
    schema = "ratio double, beta double, se double, sigma2 double, nn double, criterion double, z double, p double"
    rows = []
    if at is not None:
        z = at["beta"] / at["se"] if at["se"] > 0 else math.copysign(math.inf, at["beta"])
        rows = [(at["ratio"], at["beta"], at["se"], at["sigma2"], at["nn"], at["criterion"], z, math.erfc(abs(z) / math.sqrt(2)))]
    return df.sparkSession.createDataFrame(rows, schema)
