"""Distribution comparison of two sides of a long table (feature, value, side 0 or 1)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.functions.numbers import correlation
from diurna.operators import radix
from diurna.operators.neighbours import nearest
from diurna.operators.ranking import cumulate, one_row, quantiles
from diurna.sources.files import materialise


def _cdf(long: DataFrame, feature: str, value: str, side: str, ranked: bool = False) -> DataFrame:
    c = cumulate(long, [feature], value, {"a": F.sum((F.col(side) == 0).cast("int")), "b": F.sum((F.col(side) == 1).cast("int"))}, ranked=ranked)
    return c.withColumn("gap", F.abs(F.try_divide("cum_a", "tot_a") - F.try_divide("cum_b", "tot_b")))


def ks(long: DataFrame, feature: str, value: str, side: str) -> DataFrame:
    return _cdf(long, feature, value, side).groupBy(feature).agg(F.max("tot_a").alias("n_a"), F.max("tot_b").alias("n_b"), F.max("gap").alias("ks"))


def wasserstein(long: DataFrame, feature: str, value: str, side: str) -> DataFrame:
    """Area between the two CDFs; the next distinct value is found by rank, an equi-join."""
    c = _cdf(long, feature, value, side, ranked=True)
    nxt = c.select(feature, (F.col("cum_seq") - 1).alias("cum_seq"), F.col(value).alias("_next"))
    return c.join(nxt, [feature, "cum_seq"]).groupBy(feature).agg(F.sum(F.col("gap") * (F.col("_next") - F.col(value))).alias("wasserstein"))


def quantile_ratios(long: DataFrame, feature: str, value: str, side: str, names: dict[str, float]) -> DataFrame:
    """Per feature the quantiles of side 1 over those of side 0; null where the latter is 0 or missing."""
    q = radix.quantiles(long, [feature, side], value, names)

    def of(k, n):
        return F.max(F.when(F.col(side) == k, F.col(n)))

    return q.groupBy(feature).agg(*[F.try_divide(of(1, n), of(0, n)).alias(n) for n in names])


def psi(long: DataFrame, feature: str, value: str, side: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index over quantile bins of side 0."""
    q = quantiles(long.where(F.col(side) == 0), [feature], value, [k / bins for k in range(1, bins)])
    edges = q.select(feature, F.array_distinct(F.array(*q.columns[2:])).alias("_e"))
    d = long.where(F.col(value).isNotNull()).join(edges, feature).withColumn("_bin", F.size(F.filter("_e", lambda e: e < F.col(value))))
    g = d.groupBy(feature, "_bin").agg(F.sum((F.col(side) == 0).cast("int")).alias("a"), F.sum((F.col(side) == 1).cast("int")).alias("b"))
    tot = g.groupBy(feature).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, r = F.greatest(F.col("a") / F.col("na"), F.lit(floor)), F.greatest(F.col("b") / F.col("nb"), F.lit(floor))
    return g.join(tot, feature).groupBy(feature).agg(F.count("*").alias("n_bins"), F.sum((p - r) * F.log(p / r)).alias("psi"))


def moments(long: DataFrame, feature: str, value: str, side: str) -> DataFrame:
    """Means, sample sds and their ratio for both sides."""
    def m(f, s):
        return f(F.when(F.col(side) == s, F.col(value)))

    g = long.groupBy(feature).agg(m(F.avg, 0).alias("mean_a"), m(F.avg, 1).alias("mean_b"), m(F.stddev_samp, 0).alias("sd_a"), m(F.stddev_samp, 1).alias("sd_b"))
    return g.withColumn("sd_ratio", F.when(F.col("sd_a") > 0, F.col("sd_b") / F.col("sd_a")))


def variance_collapse(long: DataFrame, feature: str, value: str, side: str) -> DataFrame:
    """Summary over features of synthetic sd / real sd; one row per feature goes in."""
    m = moments(long, feature, value, side).where("sd_ratio is not null")
    return m.agg(F.percentile("sd_ratio", F.lit(0.5)).alias("ratio_median"), F.min("sd_ratio").alias("ratio_min"), F.max("sd_ratio").alias("ratio_max"),
                 F.sum((F.col("sd_ratio") < 0.5).cast("int")).alias("n_below_half"), F.count("*").alias("n_features")).withColumn(
        "suspected", (F.col("ratio_median") < 0.5).cast("int"))


def pair_correlations(df: DataFrame, columns, by=(), wide_limit: int = 24) -> DataFrame:
    """Pearson correlation of all column pairs: (by, a, b, r).

    Few columns: one wide aggregation, which stays in generated code. Many columns: each task adds up
    products of whole Arrow batches around common shifts (the column means) and sends one row per
    pair. A pair uses the rows in which both values are known.
    """
    pairs = list(combinations(columns, 2))
    if len(columns) <= wide_limit:
        wide = df.groupBy(*by).agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))
    by, names = list(by), list(columns)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()  # one row, schema wide
    shift = np.array([np.nan if m is None else m for m in means], float)
    i, j = (np.array(x) for x in zip(*combinations(range(len(names)), 2), strict=True))

    def products(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                x = part[names].to_numpy(float) - shift
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                s = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums[key] + s if key in sums else s
        for key, s in sums.items():
            out = pd.DataFrame({"_i": i, "_j": j, **{f"_s{k}": s[k][i, j] for k in range(6)}})
            for c, v in zip(by, key):
                out[c] = v
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(["_i int", "_j int", *[f"_s{k} double" for k in range(6)], *[f"{c} {kinds[c]}" for c in by]])
    total = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(products, schema).groupBy(*by, "_i", "_j").agg(*[F.sum(f"_s{k}").alias(f"_s{k}") for k in range(6)])
    n, sx, sy, sxx, syy, sxy = (F.col(f"_s{k}") for k in range(6))
    spread = F.sqrt(F.greatest(sxx - sx * sx / n, F.lit(0.0))) * F.sqrt(F.greatest(syy - sy * sy / n, F.lit(0.0)))
    label = F.array(*[F.lit(c) for c in names])
    return total.where(n > 0).select(*by, F.get(label, F.col("_i")).alias("a"), F.get(label, F.col("_j")).alias("b"), F.try_divide(sxy - sx * sy / n, spread).alias("r"))


def correlation_difference(df: DataFrame, columns, side: str) -> DataFrame:
    """Frobenius norm, mean and maximum of the difference of the two correlation matrices."""
    r = pair_correlations(df, columns, [side])
    p = r.groupBy("a", "b").agg(*[F.coalesce(F.max(F.when(F.col(side) == s, F.col("r"))), F.lit(0.0)).alias(f"r{s}") for s in (0, 1)])
    k = len(columns)
    d = F.col("r1") - F.col("r0")
    return p.agg(F.sqrt(2 * F.sum(d * d)).alias("frobenius"), (2 * F.sum(F.abs(d)) / (k * k)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"), F.lit(k).alias("n_features"))


def nearest_distance(queries: DataFrame, reference: DataFrame, columns, row_id: str, skip_self: bool = False, block: int | None = None) -> DataFrame:
    args = {"block": block} if block else {}
    return nearest(queries, reference, columns, 1, row_id, row_id, skip_self, **args).select(F.col("qid").alias(row_id), F.col("dist").alias("distance"), F.col("rid").alias("nearest_id"))


def memorisation(synthetic: DataFrame, train: DataFrame, holdout: DataFrame, columns, row_id: str, eps: float = 0.01) -> DataFrame:
    """Median distance of synthetic rows to train and holdout, duplicate rates and their ratio."""
    near = eps * len(columns) ** 0.5
    parts = {"train": nearest_distance(synthetic, train, columns, row_id), "holdout": nearest_distance(synthetic, holdout, columns, row_id),
             "real": nearest_distance(train, train, columns, row_id, skip_self=True)}
    parts = {k: materialise(d.select("distance"), "distances") for k, d in parts.items()}  # each read several times below
    long = None
    for k, d in parts.items():
        d = d.select(F.lit(k).alias("pair"), "distance")
        long = d if long is None else long.unionAll(d)
    q = quantiles(long, ["pair"], "distance", [0.05, 0.5]).groupBy().pivot("pair", list(parts)).agg(F.max("q50").alias("median"), F.max("q5").alias("p05"))
    rates = parts["train"].agg(F.count("*").alias("n_synthetic"), F.avg((F.col("distance") == 0).cast("double")).alias("exact_rate"), F.avg((F.col("distance") < near).cast("double")).alias("near_rate"))
    return rates.transform(one_row, q).select(  # one row each
        "n_synthetic", F.col("train_median").alias("train_median"), F.col("train_p05").alias("train_p05"), "holdout_median", F.col("real_median").alias("baseline_median"),
        "exact_rate", "near_rate", F.try_divide("train_median", "holdout_median").alias("ratio"))
