"""Ranking, threshold and class metrics on long score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.ranking import cumulate, quantiles, row_midranks


def counts_by_score(df: DataFrame, group, score: str, label: str, weight: str | None = None, ranked: bool = False) -> DataFrame:
    """Positives and negatives per distinct score with running and total counts."""
    w = F.col(weight) if weight else F.lit(1)
    return cumulate(df, group, score, {
        "pos": F.sum(F.when(F.col(label) == 1, w).otherwise(0)), "neg": F.sum(F.when(F.col(label) == 0, w).otherwise(0))}, ranked=ranked)


def auc_of(c: DataFrame, group) -> DataFrame:
    below = F.col("cum_neg") - F.col("neg")
    return c.groupBy(*group).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("_a"), F.max("tot_pos").alias("n_pos"), F.max("tot_neg").alias("n_neg")
    ).select(*group, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_a") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc_auc(df: DataFrame, group, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Midrank AUC; NULL when one class is absent."""
    return auc_of(counts_by_score(df, group, score, label, weight), list(group))


def average_precision(df: DataFrame, group, score: str, label: str) -> DataFrame:
    c = counts_by_score(df, group, score, label)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return c.groupBy(*group).agg(
        F.when((F.max("tot_pos") > 0) & (F.max("tot_neg") > 0), F.sum(F.col("pos") / F.greatest(F.col("tot_pos"), F.lit(1)) * tp / (tp + fp))).alias("ap"),
        (F.max("tot_pos") / (F.max("tot_pos") + F.max("tot_neg"))).alias("prevalence"))


def confusion(df: DataFrame, group, label: str, predicted: Column) -> DataFrame:
    y = F.col(label) == 1
    g = df.withColumn("_p", predicted).groupBy(*group).agg(
        F.count(F.when(y & F.col("_p"), 1)).alias("tp"), F.count(F.when(~y & F.col("_p"), 1)).alias("fp"),
        F.count(F.when(~y & ~F.col("_p"), 1)).alias("tn"), F.count(F.when(y & ~F.col("_p"), 1)).alias("fn"))
    return with_rates(g)


def with_rates(g: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.withColumns({
        "sensitivity": z(tp, tp + fn), "specificity": z(tn, tn + fp), "precision": z(tp, tp + fp), "npv": z(tn, tn + fn),
        "f1": z(2 * tp, 2 * tp + fp + fn), "accuracy": z(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (z(tp, tp + fn) + z(tn, tn + fp)) / 2,
        "mcc": z(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})


def brier_logloss(df: DataFrame, group, label: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    y = F.col(label)
    return df.groupBy(*group).agg(F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("logloss"))


def multiclass_loss(df: DataFrame, group, label: str, probs, eps: float = 1e-15) -> DataFrame:
    hit = [(F.col(label) == k).cast("double") for k in range(len(probs))]
    brier = reduce(lambda a, b: a + b, [F.pow(F.col(p) - h, 2) for p, h in zip(probs, hit)])
    chosen = reduce(lambda a, b: a + b, [F.col(p) * h for p, h in zip(probs, hit)])
    return df.groupBy(*group).agg(F.avg(brier).alias("brier"), (-F.avg(F.log(F.greatest(F.least(chosen, F.lit(1 - eps)), F.lit(eps))))).alias("logloss"))


def argmax(cols) -> Column:
    a = F.array(*[F.col(c) for c in cols])
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def multiclass(df: DataFrame, label: str, probs) -> DataFrame:
    """Per class precision, recall, F1, one-vs-rest AUC and AP and its row of the confusion matrix (``pred_j``), then a macro row (class -1)."""
    k = len(probs)
    d = df.withColumn("_pred", argmax(probs))
    cells = d.groupBy(label, "_pred").agg(F.count("*").alias("c"))
    classes = F.sequence(F.lit(0), F.lit(k - 1))
    per = cells.withColumn("cls", F.explode(classes)).groupBy("cls").agg(
        F.sum(F.when((F.col(label) == F.col("cls")) & (F.col("_pred") == F.col("cls")), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(label) == F.col("cls"), F.col("c")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("_pred") == F.col("cls"), F.col("c")).otherwise(0)).alias("chosen"),
        *[F.sum(F.when((F.col(label) == F.col("cls")) & (F.col("_pred") == j), F.col("c")).otherwise(0)).alias(f"pred_{j}") for j in range(k)])
    row = [f"pred_{j}" for j in range(k)]
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.select("cls", "support", *row, z("tp", "chosen").alias("precision"), z("tp", "support").alias("recall"),
                     z(2 * F.col("tp"), F.col("support") + F.col("chosen")).alias("f1"))
    long = d.select(F.inline(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(p).alias("s"), (F.col(label) == i).cast("int").alias("t")) for i, p in enumerate(probs)])))
    per = per.join(roc_auc(long, ["cls"], "s", "t").select("cls", "auc"), "cls").join(average_precision(long, ["cls"], "s", "t").select("cls", "ap"), "cls")
    macro = per.agg(F.lit(-1).alias("cls"), F.sum("support").alias("support"), *[F.sum(c).alias(c) for c in row], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "auc", "ap")])
    return per.unionByName(macro)


def top_k_precision(df: DataFrame, group, score: str, label: str, k: int, tie: str) -> DataFrame:
    """Precision of the k highest scores; the bound on row_number limits each task before the shuffle."""
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), tie))).where(F.col("_r") <= k)
    g = top.groupBy(*group).agg(F.count("*").alias("k"), F.avg(label).alias("precision_at_k"))
    tot = df.groupBy(*group).agg(F.sum(label).alias("n_positive"))
    return g.join(tot, list(group)).withColumn("max_possible", F.least("n_positive", "k") / F.col("k"))


def to_subject(df: DataFrame, subject: str, score: str, label: str, order: str, threshold: float) -> DataFrame:
    """Window scores to one row per subject: mean, median, last and majority vote."""
    base = df.groupBy(subject).agg(
        F.first(label).alias(label), F.count("*").alias("n"), F.avg(score).alias("mean"),
        F.max(F.struct(order, score))[score].alias("last"), F.avg((F.col(score) >= threshold).cast("double")).alias("vote"))
    med = quantiles(df, [subject], score, [0.5], ranges=8).select(subject, F.col("q50").alias("median"))
    return base.join(med, subject)


def repeated_oof(df: DataFrame, key, score: str, threshold: float, repeats: int) -> DataFrame:
    return df.groupBy(*key).agg(
        F.avg(score).alias("mean_score"), F.avg((F.col(score) >= threshold).cast("double")).alias("vote_rate"),
        F.stddev_samp(score).alias("sd_score"), F.count("*").alias("n")).withColumn("complete", (F.col("n") == repeats).cast("int"))


# ------------------------------------------------------------------ thresholds
def roc_points(df: DataFrame, group, score: str, label: str) -> DataFrame:
    """One row per distinct score used as cut (score >= cut) with counts and rates.

    ``corner`` marks the points that remain when collinear points are dropped, and
    ``next_score`` is the next higher score: neighbours are found by distinct rank, an
    equi-join, because they may lie in another value range.
    """
    group = list(group)
    c = counts_by_score(df, group, score, label, ranked=True)
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    d = c.select(*group, F.col(score).alias("cut"), "pos", "neg", F.col("cum_seq").alias("r"), F.col("tot_seq").alias("n_cuts"),
                 tp.alias("tp"), fp.alias("fp"), (F.col("tot_pos") - tp).alias("fn"), (F.col("tot_neg") - fp).alias("tn"))
    d = d.withColumns({"tpr": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})
    lower = d.select(*group, (F.col("r") + 1).alias("r"), F.col("pos").alias("_lp"), F.col("neg").alias("_ln"))
    upper = d.select(*group, (F.col("r") - 1).alias("r"), F.col("cut").alias("next_score"))
    d = d.join(lower, [*group, "r"], "left").join(upper, [*group, "r"], "left")
    same = (F.col("_lp") == F.col("pos")) & (F.col("_ln") == F.col("neg"))
    return d.withColumn("corner", F.when(F.col("_lp").isNull(), True).otherwise(~same)).drop("_lp", "_ln")


def _tidy(c: Column) -> Column:
    """Objective values equal up to rounding noise are ties."""
    return F.round(c, 12)


def youden(points: DataFrame, group, fixed: float = 0.5) -> DataFrame:
    """Lowest cut with the largest sens + spec - 1; cuts that leave one side empty are skipped."""
    j = _tidy(F.col("tpr") - F.col("fpr"))
    ok = (F.col("tp") + F.col("fp") > 0) & (F.col("tn") + F.col("fn") > 0)
    best = F.max(F.when(ok, F.struct(j.alias("j"), (-F.col("cut")).alias("c"))))
    return points.groupBy(*group).agg(best.alias("_b"), F.sum((~ok).cast("int")).alias("n_degenerate")).select(
        *group, F.coalesce(-F.col("_b.c"), F.lit(fixed)).alias("threshold"), F.col("_b.j").alias("value"), "n_degenerate")


def balanced_cut(points: DataFrame, group) -> DataFrame:
    """Lowest midpoint between neighbouring scores with the best balanced accuracy."""
    mid = (F.col("cut") + F.col("next_score")) / 2
    # A cut just above this score: this score's rows fall below it.
    sens = (F.col("tp") - F.col("pos")) / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    spec = (F.col("tn") + F.col("neg")) / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    best = F.max(F.when(F.col("next_score").isNotNull(), F.struct(_tidy((sens + spec) / 2).alias("v"), (-mid).alias("c"))))
    return points.groupBy(*group).agg(best.alias("_b"), F.min("cut").alias("_only")).select(
        *group, F.coalesce(-F.col("_b.c"), F.col("_only")).alias("threshold"), F.col("_b.v").alias("value"))


def specificity_cut(points: DataFrame, group, target: float) -> DataFrame:
    spec = F.try_divide("tn", F.col("tn") + F.col("fp"))
    return points.groupBy(*group).agg(F.coalesce(F.min(F.when(spec >= target, F.col("cut"))), F.max("cut") + 1e-6).alias("threshold"))


def tier_cuts(points: DataFrame, group, recall: float = 0.75, specificity: float = 0.80) -> DataFrame:
    """Screening, balanced and confirmation cuts over the corner points of the curve."""
    p = points.where("corner")
    best = F.max(F.struct(_tidy(F.col("tpr") - F.col("fpr")).alias("j"), F.col("cut").alias("c")))["c"]
    return p.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("tpr") >= recall, F.col("cut"))), best).alias("tier1_screen"), best.alias("tier2_diag"),
        F.coalesce(F.min(F.when(1 - F.col("fpr") >= specificity, F.col("cut"))), best).alias("tier3_conf"))


def operating_point(points: DataFrame, group, sensitivity: float) -> DataFrame:
    """Corner point closest to the target sensitivity (highest cut on ties)."""
    p = points.where("corner")
    m = F.min(F.struct(_tidy(F.abs(F.col("tpr") - sensitivity)).alias("d"), (-F.col("cut")).alias("c"), "tpr", "fpr"))
    return p.groupBy(*group).agg(m.alias("_m")).select(*group, (-F.col("_m.c")).alias("threshold"), F.col("_m.tpr").alias("sensitivity"), (1 - F.col("_m.fpr")).alias("specificity"))


def quantile_transfer(inner: DataFrame, test: DataFrame, group, score: str, label: str) -> DataFrame:
    """The training cut (largest Youden, then largest cut) carried to test scores as a rank position."""
    group = list(group)
    p = roc_points(inner, group, score, label)
    t = p.groupBy(*group).agg(F.max(F.struct(_tidy(F.col("tpr") - F.col("fpr")).alias("j"), F.col("cut").alias("c"),
                                             F.try_divide(F.col("tn") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("q"))).alias("_b"))
    t = t.select(*group, F.col("_b.q").alias("q"))
    r = row_midranks(test, group, score).withColumn("_pct", (F.col("midrank") - 0.5) / F.col("n")).drop("midrank", "n")
    return r.join(t, group).withColumn("prediction", (F.col("_pct") >= F.col("q")).cast("int")).drop("_pct")


def implied_prevalence(sens: Column, spec: Column, prec: Column) -> Column:
    fpr = 1 - spec
    den = prec * sens - prec * fpr - sens
    v = F.try_divide(-prec * fpr, F.when(F.abs(den) >= 1e-12, den))
    return F.when((fpr > 0) & (sens > 0) & (v > 0) & (v <= 1), v)


def calibration(df: DataFrame, group, label: str, p: str, bins: int = 10) -> DataFrame:
    b = F.greatest(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.lit(0)).alias("bin")
    return df.groupBy(*group, b).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(label).alias("observed_rate"))
