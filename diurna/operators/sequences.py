"""Windows of days, calendar runs and rank transforms.

Windows partition by subject over one row per calendar day, so a partition is bounded by
the study length; the same partitioning serves runs, windows and rolling statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.radix import quantiles
from diurna.operators.ranking import one_row, row_counts, row_midranks


def rolling(df: DataFrame, keys, order: str, value: str, width: int = 7) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumns({"roll_mean": F.avg(value).over(w), "roll_std": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))})


def rolling_std(df: DataFrame, keys, order: str, value: str, width: int, min_n: int) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(w) >= min_n, F.stddev_pop(value).over(w))


def fill_both_ways(keys, order: str, value: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                      F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def with_runs(df: DataFrame, subject: str, date: str) -> DataFrame:
    """Adds ``run_start`` (first day of the calendar run) and ``run_pos`` (0-based day in it)."""
    rn = F.row_number().over(Window.partitionBy(subject).orderBy(date))
    d = df.withColumn("_isl", F.date_sub(date, rn))
    w = Window.partitionBy(subject, "_isl")
    return d.withColumns({"run_start": F.min(date).over(w), "run_pos": F.row_number().over(w.orderBy(date)) - 1}).drop("_isl")


def windows(df: DataFrame, subject: str, date: str, row_id: str, values, length: int, stride: int = 1, consecutive: bool = True) -> DataFrame:
    """Fixed-length windows with provenance; with ``consecutive`` no window leaves its calendar run."""
    d = with_runs(df, subject, date)
    part = [subject, "run_start"] if consecutive else [subject]
    w = Window.partitionBy(*part).orderBy(date)
    pos = F.row_number().over(w) - 1
    item = F.struct(F.col(date).alias("date"), F.col(row_id).alias("row_id"), *[F.col(v).alias(v) for v in values])
    d = d.withColumns({"_pos": pos, "days": F.collect_list(item).over(w.rowsBetween(0, length - 1))})
    d = d.where((F.size("days") == length) & (F.col("_pos") % stride == 0))
    end = F.element_at("days", -1)["date"]
    return d.select(subject, F.col(date).alias("start_date"), end.alias("end_date"), "days",
                    (F.datediff(end, date) == length - 1).cast("int").alias("is_consecutive"))


def leak_report(wins: DataFrame, cuts: DataFrame, subject: str) -> DataFrame:
    """Windows cut before the split: crossing windows and dates that end up on both sides."""
    d = wins.join(cuts, subject).withColumns({
        "_all": F.forall("days", lambda x: x["date"] >= F.col("cut")), "_any": F.exists("days", lambda x: x["date"] >= F.col("cut"))})
    counts = d.agg(
        F.count("*").alias("n_windows"), F.sum((F.col("_any") & ~F.col("_all")).cast("int")).alias("n_crossing"),
        F.sum(1 - F.col("is_consecutive")).alias("n_gap"), F.sum(F.col("_all").cast("int")).alias("n_test"))
    dates = d.select(subject, F.col("_all").cast("int").alias("t"), F.explode("days.date").alias("date")).groupBy(subject, "date").agg(
        F.max("t").alias("in_test"), F.min("t").alias("only_test"))
    shared = dates.agg(F.sum(((F.col("in_test") == 1) & (F.col("only_test") == 0)).cast("int")).alias("n_shared_dates"),
                       F.sum("in_test").alias("n_test_dates"))
    return counts.transform(one_row, shared).withColumn(  # one row each
        "leak_share", F.coalesce(F.try_divide("n_shared_dates", "n_test_dates"), F.lit(0.0)))


def gap_spanning(df: DataFrame, subject: str, date: str, lengths) -> DataFrame:
    """Share of L-row windows that span a calendar gap, with run statistics over subjects."""
    w = Window.partitionBy(subject).orderBy(date)
    d = df.select(subject, date, *[F.datediff(date, F.lag(date, n - 1).over(w)).alias(f"_s{n}") for n in lengths],
                  (F.datediff(date, F.lag(date).over(w)) > 1).alias("_gap"))
    per_l = d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"_s{n}").alias("s")) for n in lengths]))).where("s is not null")
    shares = per_l.groupBy("length").agg(F.count("*").alias("n_windows"), F.sum((F.col("s") > F.col("length") - 1).cast("int")).alias("n_gap"))
    runs = with_runs(df.select(subject, date), subject, date).groupBy(subject, "run_start").agg(F.count("*").alias("len"))
    per_subject = runs.groupBy(subject).agg(F.count("*").alias("runs"), F.max("len").alias("longest"))
    # Run counts and lengths take at most study-length distinct values, so the percentile state is small.
    facts = per_subject.agg(
        F.sum((F.col("runs") > 1).cast("int")).alias("subjects_with_gap"), F.sum(F.col("runs") - 1).alias("total_gaps"),
        F.percentile("runs", F.lit(0.5)).alias("runs_median"), F.max("runs").alias("runs_max"),
        F.min("longest").alias("longest_min"), F.percentile("longest", F.lit(0.5)).alias("longest_median"))
    return shares.withColumn("share", F.try_divide("n_gap", "n_windows")).transform(one_row, facts)


def padded_sequence(df: DataFrame, subject: str, order: str, values, steps: int, keep: str = "last", side: str = "left", pad: float = -1.0) -> DataFrame:
    """One padded sequence per subject as array<struct<mask, values...>>."""
    item = F.struct(F.col(order).alias("_o"), *[F.col(v).cast("double").alias(v) for v in values])
    s = df.groupBy(subject).agg(F.sort_array(F.collect_list(item)).alias("a"))
    s = s.withColumn("a", F.slice("a", F.greatest(F.size("a") - steps + 1, F.lit(1)), steps) if keep == "last" else F.slice("a", 1, steps))
    real = F.transform("a", lambda x: F.struct(F.lit(1).alias("mask"), *[x[v].alias(v) for v in values]))
    empty = F.array_repeat(F.struct(F.lit(0).alias("mask"), *[F.lit(pad).alias(v) for v in values]), steps - F.size("a"))
    return s.select(subject, F.size("a").alias("n_real"), (F.concat(empty, real) if side == "left" else F.concat(real, empty)).alias("steps"))


def length_facts(df: DataFrame, subject: str) -> DataFrame:
    """One row: the least, median and greatest number of rows per subject, from which a padded length is chosen."""
    size = df.groupBy(subject).agg(F.count("*").alias("t"))
    per = size.groupBy("t").agg(F.count("*").alias("c"))  # as many rows as there are distinct lengths
    return per.agg(F.min("t").alias("t_min"), F.percentile("t", 0.5, F.col("c")).alias("t_median"), F.max("t").alias("t_max"))


def flatten(wins: DataFrame, keep, values, length: int, mode: str = "wide") -> DataFrame:
    """Window arrays to columns: every step, the mean, or the last step of each value."""
    def cols(v):
        if mode == "wide":
            return [F.element_at("days", i + 1)[v].alias(f"{v}__t{i}") for i in range(length)]
        if mode == "mean":
            from diurna.functions import series as S
            return [S.mean(F.transform("days", lambda x: x[v])).alias(f"{v}__mean")]
        return [F.element_at("days", -1)[v].alias(f"{v}__last")]

    return wins.select(*keep, *[c for v in values for c in cols(v)])


def own_zscore(keys, value: str) -> Column:
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8)
    return F.when(F.count(value).over(w) < 2, F.lit(0.0)).otherwise(F.coalesce(z, F.lit(0.0)))


def midrank_percentile(df: DataFrame, group, value: str) -> DataFrame:
    """(average rank - 0.5) / n for each row; missing values get 0.5."""
    r = row_midranks(df, group, value).select(*df.columns, ((F.col("midrank") - 0.5) / F.col("n")).alias("pct"))
    return r.unionByName(df.where(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).withColumn("pct", F.lit(0.5)))


def reference_ecdf(reference: DataFrame, query: DataFrame, value: str, group=()) -> DataFrame:
    """(count below + count at or below) / 2n of each query value in its group's frozen reference; null without value or reference.

    Reference and query rows are dealt together by value range, and the query's rows come back from that pass.
    """
    group = list(group)
    both = reference.select(*group, value).withColumn("_r", F.lit(1)).unionByName(query.withColumn("_r", F.lit(0)), allowMissingColumns=True)
    c = row_counts(both, group, value, "_r").where("_r = 0")
    placed = c.select(*query.columns, F.try_divide(2 * F.col("n_below") + F.col("n_equal"), 2 * F.col("n_all")).alias("ecdf"))
    return placed.unionByName(query.where(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).withColumn("ecdf", F.lit(None).cast("double")))


def quantile_bins(df: DataFrame, group, value: str, bins: int = 5) -> DataFrame:
    """0-based equal-frequency bin per row; right-closed, duplicate edges merged."""
    names = {f"_q{k}": k / bins for k in range(bins + 1)}
    edges = quantiles(df, group, value, names).select(*group, F.array_distinct(F.array(*names)).alias("_e"))
    j = df.join(edges, list(group))
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    return j.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(value)))).drop("_e")
