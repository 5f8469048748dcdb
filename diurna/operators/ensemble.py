"""Blends, cascades, probability rules, contribution summaries and frozen scoring."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.numbers import clip
from diurna.operators.draws import draw_sums
from diurna.operators.metrics import roc_auc
from diurna.operators.radix import quantiles
from diurna.operators.ranking import one_row, row_midranks, spearman
from diurna.operators.sequences import reference_ecdf
from diurna.sources.files import materialise


def blend(df: DataFrame, keys, model: str, score: str, weights: dict[str, float]) -> DataFrame:
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    total = sum(weights.values())
    return df.groupBy(*keys).agg((F.sum(F.col(score) * F.try_element_at(w, F.col(model))) / total).alias("blend"))


def rank_scores(df: DataFrame, group, score: str, out: str = "rank_score") -> DataFrame:
    return row_midranks(df, group, score).select(*df.columns, ((F.col("midrank") - 0.5) / F.col("n")).alias(out))


def weight_candidates(models, draws: int, seed: int, floor: tuple[str, float] | None = None) -> list[tuple[str, dict[str, float]]]:
    """Unit vectors, equal weights and seeded flat-Dirichlet draws; optionally a floor on one member."""
    import hashlib

    def unit(*parts):
        return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0

    out = [(f"unit_{m}", {k: float(k == m) for k in models}) for m in models] + [("equal", {k: 1.0 / len(models) for k in models})]
    for d in range(draws):
        e = {m: -math.log(1 - unit(seed, d, m)) for m in models}
        s = sum(e.values())
        out.append((f"draw_{d}", {m: v / s for m, v in e.items()}))
    if floor:
        name, low = floor
        fixed = []
        for k, w in out:
            if w[name] < low:
                rest = sum(v for m, v in w.items() if m != name)
                w = {m: (low if m == name else v * (1 - low) / rest) for m, v in w.items()}
            fixed.append((k, w))
        out = fixed
    return out


def weight_search(df: DataFrame, keys, model: str, score: str, label: str, candidates, by=()) -> DataFrame:
    """AUC of every candidate in each group of ``by``, in one plan; best by AUC, then least concentrated, then first."""
    by = list(by)
    models = list(candidates[0][1])
    wide = df.groupBy(*by, *keys, label).agg(*[F.max(F.when(F.col(model) == m, F.col(score))).alias(f"_s_{m}") for m in models])
    rows = F.array(*[F.struct(F.lit(i).alias("wid"), F.lit(k).alias("candidate"), F.lit(sum(v * v for v in w.values())).alias("concentration"),
                              F.round(reduce(lambda a, b: a + b, [F.col(f"_s_{m}") * w[m] for m in models]), 9).alias("_b")) for i, (k, w) in enumerate(candidates)])
    a = roc_auc(wide.select(*by, label, F.inline(rows)), [*by, "wid", "candidate", "concentration"], "_b", label)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.round("auc", 12).desc(), F.round("concentration", 12), "wid")  # one row per candidate
    return a.withColumn("chosen", (F.row_number().over(w) == 1).cast("int"))


def gated_weights(metric: DataFrame, group, model: str, value: str, gate: float) -> DataFrame:
    """metric - 0.5 for members at or above the gate, else the single best member."""
    w = Window.partitionBy(*group)
    ok = (F.col(value) >= gate) & (F.col(value) > 0.5)
    best = F.row_number().over(w.orderBy(F.col(value).desc(), model)) == 1
    d = metric.withColumns({"_any": F.max(ok.cast("int")).over(w), "_best": best.cast("int")})
    raw = F.when(F.col("_any") == 1, F.when(ok, F.col(value) - 0.5).otherwise(0.0)).otherwise(F.col("_best").cast("double"))
    d = d.withColumns({"_raw": raw, "mode": F.when(F.col("_any") == 1, "gated_blend").otherwise("fallback_best")})
    return d.withColumn("weight", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw", "_any", "_best")


def hierarchy(d: Column, q: Column) -> dict[str, Column]:
    """P(severe) and P(mild | not severe) to three normalised class scores."""
    lo, hi = F.lit(1e-9), F.lit(1 - 1e-9)
    d, q = clip(d, lo, hi), clip(q, lo, hi)
    return {"p0": (1 - d) * (1 - q), "p1": (1 - d) * q, "p2": d}


def cascade(d: Column, q: Column, t1: float, t2: float) -> Column:
    return F.when(d >= t1, 2).when(q >= t2, 1).otherwise(0)


def temperature(cols, t: float) -> dict[str, Column]:
    p = [F.pow(F.col(c), F.lit(1.0 / t)) for c in cols]
    s = reduce(lambda a, b: a + b, p)
    return {c: e / s for c, e in zip(cols, p)}


def normalise(df: DataFrame, cols, clip_first: bool = False) -> DataFrame:
    """Row-normalised probabilities; invalid rows keep NULLs and a reason."""
    s = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) for c in cols])
    neg = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in cols])
    if clip_first:
        e = {c: clip(F.col(c), F.lit(1e-7), F.lit(1.0)) for c in cols}
        tot = reduce(lambda a, b: a + b, e.values())
        return df.withColumns({**{c: F.when(~bad, e[c] / tot) for c in cols}, "reason": F.when(bad, "not_finite")})
    reason = F.when(bad, "not_finite").when(neg, "negative").when(s <= 0, "zero_mass")
    return df.withColumn("reason", reason).withColumns({c: F.when(F.col("reason").isNull(), F.try_divide(F.col(c), s)) for c in cols})


def prior_baseline(train: DataFrame, test: DataFrame, label: str, classes) -> DataFrame:
    """Train class shares (one row) attached to every test row, with the majority class."""
    c = train.groupBy(label).agg(F.count("*").alias("c"))
    r = c.agg(*[(F.sum(F.when(F.col(label) == k, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"p{k}") for k in classes],
              F.max(F.struct("c", (-F.col(label)).alias("l")))["l"].alias("_m"))
    return test.transform(one_row, r.withColumn("majority", -F.col("_m")).drop("_m"))


# ------------------------------------------------------------------ contributions
def contribution_summary(df: DataFrame, row_id: str, feature: str, value: str, fold: str, draws: int, seed: int) -> DataFrame:
    """Mean |contribution|, share, rank, fold range, top-5 rows and a bootstrap interval over rows."""
    d = df.withColumn("_a", F.abs(value))
    g = d.groupBy(feature).agg(F.avg("_a").alias("mean_abs"))
    w = Window.partitionBy(F.lit(0))  # one row per feature
    g = g.withColumns({"share": F.col("mean_abs") / F.sum("mean_abs").over(w), "rank": F.row_number().over(w.orderBy(F.col("mean_abs").desc(), feature))})
    f = d.groupBy(feature, fold).agg(F.avg("_a").alias("m")).groupBy(feature).agg(F.min("m").alias("fold_min"), F.max("m").alias("fold_max"))
    top = d.withColumn("_r", F.row_number().over(Window.partitionBy(row_id).orderBy(F.col("_a").desc(), feature))).groupBy(feature).agg(F.sum((F.col("_r") <= 5).cast("int")).alias("top5_rows"))
    b = draw_sums(d, [feature], row_id, {"_s": F.col("_a"), "_w": F.col("_a").isNotNull().cast("int")}, draws, seed)
    b = b.select(feature, F.try_divide("_s", "_w").alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))  # one row per draw
    b = b.groupBy(feature).agg(p.alias("_p")).select(feature, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))
    return g.join(f, feature).join(top, feature).join(b, feature)


def contribution_direction(df: DataFrame, feature: str, x: str, contribution: str, label: str) -> DataFrame:
    rho = spearman(df, [feature], x, contribution).select(feature, "rho")
    med = quantiles(df, [feature, label], x, {"q50": 0.5}).groupBy(feature).agg(
        F.max(F.when(F.col(label) == 0, F.col("q50"))).alias("median_0"), F.max(F.when(F.col(label) == 1, F.col("q50"))).alias("median_1"))
    m = df.groupBy(feature).agg(F.avg(F.when(F.col(label) == 0, F.col(contribution))).alias("mean_0"), F.avg(F.when(F.col(label) == 1, F.col(contribution))).alias("mean_1"))
    return rho.join(med, feature).join(m, feature)


def rank_stability(df: DataFrame, feature: str, value: str, fold: str, k: int) -> DataFrame:
    m = df.groupBy(fold, feature).agg(F.avg(F.abs(value)).alias("m"))
    r = m.withColumn("rank", F.row_number().over(Window.partitionBy(fold).orderBy(F.col("m").desc(), feature)))
    n = df.select(fold).distinct().agg(F.count("*").alias("_n"))
    return r.groupBy(feature).agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("sd_rank"), F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"),
                                  F.sum((F.col("rank") <= k).cast("int")).alias("folds_in_top")).transform(one_row, n).withColumn(
        "always_top", (F.col("folds_in_top") == F.col("_n")).cast("int")).drop("_n")


def over_time(df: DataFrame, keys, time: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(F.abs(value)).alias("abs_mean"), F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.max(F.struct(time, value))[value].alias("last"))


def risk(df: DataFrame, keys, row_id: str, contribution: str) -> DataFrame:
    """Sum of positive contributions per row, then the mean over the rows of a key."""
    r = df.groupBy(*keys, row_id).agg(F.sum(F.greatest(F.col(contribution), F.lit(0.0))).alias("_r"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_r").alias("risk"), F.max("_r").alias("max_risk"))


def frozen_scores(prepared: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    z = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in coefficients.items()]) + intercept
    return prepared.withColumn("score", 1 / (1 + F.exp(-z)))


def score_frozen(train_prepared: DataFrame, new_prepared: DataFrame, row_id: str, coefficients, intercept: float, missing: str, max_missing: int) -> DataFrame:
    """Stored coefficients, logistic score and position in the frozen train reference; rows with too many gaps are refused."""
    # stored: ranks read the scores several times, and a score is as long an expression as the schema is wide
    ref = materialise(frozen_scores(train_prepared, coefficients, intercept).select(F.round("score", 9).alias("score")), "reference")
    new = materialise(frozen_scores(new_prepared, coefficients, intercept).select(row_id, missing, F.round("score", 9).alias("score")), "scores")
    ok = F.col(missing) <= max_missing
    placed = reference_ecdf(ref, new.where(ok), "score").withColumn("status", F.lit("scored"))
    refused = new.where(~ok).select("score", row_id, missing).withColumns({"score": F.lit(None).cast("double"), "ecdf": F.lit(None).cast("double"), "status": F.lit("refused")})
    return placed.select(row_id, "score", "ecdf", "status").unionByName(refused.select(row_id, "score", "ecdf", "status"))

