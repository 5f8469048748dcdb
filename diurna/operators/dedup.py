"""Deduplication, top-k and sampling of rows inside a subject.

Keep-one rules are min/max of a struct: they combine before the shuffle and never
sort a group, so a subject-day with very many copies costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys, order: dict[str, Column]) -> DataFrame:
    """Row with the smallest order struct per key; all columns are returned."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min(F.struct(*[e.alias(f"_o{i}") for i, e in enumerate(order.values())], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(packed.alias("_m")).select(*keys, "_m._row.*")


def keep_last(df: DataFrame, keys, order: dict[str, Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(*[e.alias(f"_o{i}") for i, e in enumerate(order.values())], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(packed.alias("_m")).select(*keys, "_m._row.*")


def longest_episode(df: DataFrame, keys, duration: str, start: str, end: str) -> DataFrame:
    """Longest episode per key; ties by earlier start, earlier end, then row digest."""
    digest = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]), 256)
    return keep_first(df, keys, {"d": -F.col(duration), "s": F.col(start), "e": F.col(end), "h": digest})


def dedup_policy(df: DataFrame, keys, policy: str, duration: str, start: str, end: str, row_id: str) -> DataFrame:
    if policy == "longest_duration":
        return keep_first(df, keys, {"d": -F.col(duration), "s": F.col(start), "i": F.col(row_id)})
    if policy == "latest_bedtime_end":
        return keep_last(df, keys, {"e": F.col(end), "i": F.col(row_id)})
    if policy == "first":
        return keep_first(df, keys, {"i": F.col(row_id)})
    raise ValueError(f"unknown policy {policy}")


def collapse_by_rule(df: DataFrame, keys, columns, mean_words=("score", "average", "efficiency", "met", "mean")) -> DataFrame:
    """Mean for columns whose name says they are levels, sum for counts and totals."""
    return df.groupBy(*keys).agg(*[
        (F.avg(c) if any(w in c.lower() for w in mean_words) else F.sum(c)).alias(c) for c in columns])


def collapse_median(df: DataFrame, keys, columns) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns])


def last_n(df: DataFrame, subject: str, n: int, *order: Column) -> DataFrame:
    """Spark turns the row_number bound into a per-task group limit before the shuffle."""
    w = Window.partitionBy(subject).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def first_n_or_refuse(df: DataFrame, subject: str, date: str, n: int) -> DataFrame:
    w = Window.partitionBy(subject)
    return (df.withColumns({"rn": F.row_number().over(w.orderBy(date)), "_n": F.count("*").over(w)})
            .where((F.col("rn") <= n) & (F.col("_n") >= n)).drop("_n"))


def top_k(df: DataFrame, by, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def largest_changes(long: DataFrame, k: int) -> DataFrame:
    """Top-k absolute day-to-day changes per subject and channel."""
    w = Window.partitionBy("subject_id", "channel").orderBy("day_index")
    d = long.withColumns({"_pd": F.lag("day_index").over(w), "change": F.col("value") - F.lag("value").over(w)}).where(
        (F.col("day_index") - F.col("_pd") == 1) & F.col("change").isNotNull())
    return top_k(d.drop("_pd"), ["subject_id", "channel"], k, F.abs("change").desc(), F.col("day_index"))


def evenly_spaced(df: DataFrame, subject: str, order: str, m: int) -> DataFrame:
    """At most m rows per subject at rounded, equally spaced positions (half to even)."""
    w = Window.partitionBy(subject)
    d = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(m - 1))).cast("int"))
    return d.where((F.col("_n") <= m) | F.array_contains(picks, F.col("_i"))).withColumnRenamed("_i", "pos").drop("_n")
