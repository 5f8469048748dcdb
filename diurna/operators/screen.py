"""Feature screening and selection over long tables (row, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.draws import auc_draws, draw_sums, subsample_steps
from diurna.operators.drift import pair_correlations
from diurna.operators.metrics import roc_auc
from diurna.operators.prep import median_impute
from diurna.operators.radix import quantiles
from diurna.operators.ranking import one_row, row_midranks
from diurna.operators.selection import column_facts


def anova_f(long: DataFrame, by, feature: str, label: str, value: str) -> DataFrame:
    """One-way ANOVA F per feature from class moments."""
    keys = [*by, feature]
    g = long.where(F.col(value).isNotNull()).groupBy(*keys, label).agg(
        F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return s.select(*keys, ((F.col("between") / (F.col("k") - 1)) / F.when(F.col("within") > 0, F.col("within") / (F.col("n") - F.col("k")))).alias("f_value"))


def best_k(df: DataFrame, by, feature: str, score: str, k: int) -> DataFrame:
    part = [F.col(c) for c in by] or [F.lit(0)]  # one row per feature
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.col(score).desc_nulls_last(), feature))).where(F.col("rank") <= k)


def direction_free_auc(long: DataFrame, by, feature: str, label: str, value: str, min_rows: int = 8, min_share: float = 0.4) -> DataFrame:
    """max(AUC, 1 - AUC); 0.5 when too few known values or one class only."""
    keys = [*by, feature]
    total = long.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(value).alias("_k"))
    a = roc_auc(long.where(F.col(value).isNotNull()), keys, value, label).select(*keys, "auc")
    enough = F.col("_k") >= F.greatest(F.lit(min_rows), F.ceil(F.col("_n") * F.lit(min_share)))
    return total.join(a, keys, "left").select(*keys, F.when(enough & F.col("auc").isNotNull(), F.greatest(F.col("auc"), 1 - F.col("auc"))).otherwise(0.5).alias("auc"))


def correlation_prune(df: DataFrame, columns, scores: DataFrame, feature: str, score: str, limit: float) -> DataFrame:
    """Greedy: keep a feature unless |r| with a kept, better one reaches the limit.

    Correlations and scores are computed by Spark; the loop runs over the feature list, whose
    length is the schema's.
    """
    r = {(x.a, x.b): x.r for x in pair_correlations(df, columns).toLocalIterator()}
    order = sorted(scores.select(feature, score).toLocalIterator(), key=lambda x: (-x[1], x[0]))
    kept: list[str] = []
    for name, _ in order:
        if all(abs(r.get((name, k), r.get((k, name), 0.0)) or 0.0) < limit for k in kept):
            kept.append(name)
    return scores.withColumn("kept", F.col(feature).isin(*kept).cast("int"))


def spearman_pairs(long: DataFrame, row_id: str, feature: str, value: str, columns) -> DataFrame:
    """All pairwise rank correlations: ranks per feature once, then one wide aggregation."""
    ranked = row_midranks(long.select(row_id, feature, value), [feature], value).groupBy(row_id).agg(*[F.max(F.when(F.col(feature) == c, F.col("midrank"))).alias(c) for c in columns])
    return pair_correlations(ranked, columns)


def stability_selection(long: DataFrame, row_id: str, feature: str, label: str, value: str, draws: int, top_k: int, seed: int,
                        share: float = 0.632, threshold: float = 0.6, at_least: int = 3, at_most: int = 40, min_rows: int = 8, min_share: float = 0.4) -> DataFrame:
    """Selection frequency over subsamples without replacement, in which every row takes part with probability ``share``.

    Rows are not copied per subsample: their 0/1 weights are vectors over the draws (``draws.auc_draws``).
    """
    steps = subsample_steps(share)
    size = draw_sums(long, [feature], row_id, {"_n": F.lit(1), "_k": F.col(value).isNotNull().cast("int")}, draws, seed, steps)
    each = size.join(auc_draws(long, [feature], row_id, value, label, draws, seed, steps), [feature, "draw"], "left")
    enough = F.col("_k") >= F.greatest(F.lit(min_rows), F.ceil(F.col("_n") * F.lit(min_share)))
    auc = each.select("draw", feature, F.when(enough & F.col("auc").isNotNull(), F.greatest(F.col("auc"), 1 - F.col("auc"))).otherwise(0.5).alias("auc"))
    chosen = best_k(auc, ["draw"], feature, "auc", top_k)
    freq = long.select(feature).distinct().join(chosen.groupBy(feature).agg((F.count("*") / F.lit(float(draws))).alias("frequency")), feature, "left").fillna(0.0, ["frequency"])
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("frequency").desc(), feature)  # one row per feature
    freq = freq.withColumns({"_r": F.row_number().over(w), "_over": F.sum((F.col("frequency") >= threshold).cast("int")).over(Window.partitionBy(F.lit(0)))})
    keep = F.when(F.col("_over") < at_least, F.col("_r") <= at_least).otherwise((F.col("frequency") >= threshold) & (F.col("_r") <= at_most))
    return freq.select(feature, "frequency", keep.cast("int").alias("selected"))


def jaccard(sets: DataFrame, fold: str, feature: str) -> DataFrame:
    """Per selected feature its number of sets and frequency, with the mean and minimum pairwise Jaccard of the sets (folds and features are few)."""
    s = sets.groupBy(fold).agg(F.collect_set(feature).alias("s"))
    b = s.select(F.col(fold).alias("_f2"), F.col("s").alias("s2"))
    j = s.join(b, F.col(fold) < F.col("_f2")).select((F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2"))).alias("j"))
    n = sets.select(fold).distinct().agg(F.count("*").alias("n_sets"))
    times = sets.groupBy(feature).agg(F.count("*").alias("times")).transform(one_row, n)
    always = times.agg(F.coalesce(F.sum((F.col("times") == F.col("n_sets")).cast("int")), F.lit(0)).alias("n_always"))
    facts = j.agg(F.avg("j").alias("mean_jaccard"), F.min("j").alias("min_jaccard")).transform(one_row, always)
    return times.withColumn("frequency", F.col("times") / F.col("n_sets")).transform(one_row, facts)


def redundancy(df: DataFrame, columns, limit: float = 0.95) -> DataFrame:
    """Number of column pairs with |r| at the limit after a median fill of the varying columns."""
    facts = column_facts(df, columns, {"k": F.count, "s": F.stddev_pop}).where("k >= 2 and s > 1e-10")
    keep = [c for c in columns if c in {x.name for x in facts.toLocalIterator()}]
    filled = median_impute(df, df, keep)
    return pair_correlations(filled, keep).agg(F.sum((F.abs("r") >= limit).cast("int")).alias("n_pairs"), F.lit(len(keep)).alias("n_columns"))


def robust_spread(long: DataFrame, keys, value: str) -> DataFrame:
    """IQR/1.349, else 1.4826 MAD, else sample sd; with the median and n."""
    q = quantiles(long, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    dev = long.join(q.select(*keys, "median"), list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(dev, keys, "_d", {"q50": 0.5}).select(*keys, (F.col("q50") * 1.4826).alias("_mad"))
    sd = long.groupBy(*keys).agg(F.stddev_samp(value).alias("_sd"))
    s = (F.col("q75") - F.col("q25")) / 1.349
    tiny = 1e-12
    return q.join(mad, list(keys)).join(sd, list(keys)).select(
        *keys, "n", "median", (F.col("q75") - F.col("q25")).alias("iqr"),
        F.when(F.col("n") < 2, F.lit(None)).when(s > tiny, s).when(F.col("_mad") > tiny, F.col("_mad")).when(F.col("_sd") > tiny, F.col("_sd")).alias("scale"))


def effects(long: DataFrame, feature: str, label: str, value: str, reference: int = 0) -> DataFrame:
    """Per feature and class: n, median, IQR, median difference, robust SMD and Cliff's delta against the reference class."""
    d = long.where(F.col(value).isNotNull())
    s = robust_spread(d, [feature, label], value)
    ref = s.where(F.col(label) == reference).select(feature, F.col("median").alias("_rm"), F.col("scale").alias("_rs"))
    j = s.join(ref, feature, "left")
    sq = F.array_compact(F.array("_rs", "scale"))
    pooled = F.sqrt(F.try_divide(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x * x), F.size(sq)))
    # reference rows are paired with each other class once; Cliff's delta is 2 AUC - 1
    others = [r[0] for r in d.select(label).distinct().toLocalIterator() if r[0] != reference]
    versus = F.when(F.col(label) == reference, F.array(*[F.lit(o) for o in others])).otherwise(F.array(F.col(label)))
    two = d.select(feature, value, F.explode(versus).alias("_c"), (F.col(label) != reference).cast("int").alias("_y"))
    a = roc_auc(two, [feature, "_c"], value, "_y").select(feature, F.col("_c").alias(label), (2 * F.col("auc") - 1).alias("_delta"))
    j = j.join(a, [feature, label], "left")
    diff = F.col("median") - F.col("_rm")
    return j.select(feature, label, "n", "median", "iqr", diff.alias("median_diff"), F.when(pooled > 1e-12, diff / pooled).alias("robust_smd"),
                    F.when(F.col(label) == reference, F.lit(0.0)).otherwise(F.col("_delta")).alias("cliffs_delta"))


def negative_controls(effect: DataFrame, feature: str, label: str, reference: int = 0) -> DataFrame:
    d = effect.where(F.col(label) != reference)
    def n(t):
        return F.count_distinct(F.when(F.abs("cliffs_delta") >= t, F.col(feature)))
    return d.agg(n(0.33).alias("n_moderate"), n(0.474).alias("n_strong"), F.max(F.abs("cliffs_delta")).alias("max_abs_delta"))


def robust_distance(long: DataFrame, row_id: str, feature: str, value: str) -> DataFrame:
    """(row, distance): sum of squared deviations from the feature medians in units of 1.4826 MAD; a MAD of 0 leaves the feature out."""
    middle = quantiles(long, [feature], value, {"_med": 0.5}).drop("n")
    dev = long.join(middle, feature).select(row_id, feature, F.abs(F.col(value) - F.col("_med")).alias("_dev"))
    spread = quantiles(dev, [feature], "_dev", {"q50": 0.5}).select(feature, (F.col("q50") * 1.4826).alias("_mad"))
    term = F.pow(F.try_divide(F.col("_dev"), F.col("_mad")), 2)
    return dev.join(spread, feature).groupBy(row_id).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("distance"))
