"""Joins of modalities, labels, calendars and minute grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def join_modalities(a: DataFrame, b: DataFrame, keys=("subject_id", "date")) -> DataFrame:
    """Inner 1:1 join. Both sides are grouped on the keys upstream, so the exchange is reused."""
    return a.join(b, list(keys), "inner")


def join_labels(df: DataFrame, labels: DataFrame, subject: str, label: str) -> DataFrame:
    """Left join; ``label_missing`` marks rows that break the contract."""
    return df.join(labels, subject, "left").withColumn("label_missing", F.col(label).isNull().cast("int"))


def presence(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Full outer presence of keys: both, left_only or right_only. One aggregation, no join."""
    both = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    m = both.groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return m.withColumn("side", F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "left_only").otherwise("right_only")).drop("_s")


def positional_join(a: DataFrame, b: DataFrame, subject: str, order_a: str, order_b: str) -> DataFrame:
    """n-th row of one side with the n-th row of the other (one row per calendar day on each side)."""
    na = a.withColumn("pos", F.row_number().over(Window.partitionBy(subject).orderBy(order_a)) - 1)
    nb = b.withColumn("pos", F.row_number().over(Window.partitionBy(subject).orderBy(order_b)) - 1)
    return na.join(nb, [subject, "pos"])


def calendar_grid(df: DataFrame, subject: str, date: str) -> DataFrame:
    """Every calendar day from a subject's first to last day, left-joined to its rows."""
    span = df.groupBy(subject).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    grid = span.select(subject, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return grid.join(df, [subject, date], "left")


def lookbacks(days: DataFrame, anchors: DataFrame, subject: str, date: str, widths) -> DataFrame:
    """Each day repeated once per look-back width that contains it."""
    age = F.datediff("anchor", date)
    j = days.join(anchors.select(subject, "anchor"), subject).where((age >= 0) & (age < max(widths)))
    fits = F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: age < w)
    return j.withColumn("width", F.explode(fits))


def minute_grid(series: DataFrame, intervals: DataFrame, subject: str = "subject_id", start_minute: int = 240) -> DataFrame:
    """Minutes of day-anchored series and of clock intervals on one grid of days that start at 04:00.

    ``series``: subject, date, pos, channel, value (pos 0 is the anchor minute).
    ``intervals``: subject, start_ts, end_ts, channel, value; a minute belongs to an interval if
    it begins inside it. Later rows win. Absolute minutes make the spill into neighbour days a
    division; keep-last is an aggregate, so it combines before the shuffle.
    """
    day0 = F.lit("1970-01-01").cast("date")
    a = series.select(
        subject, "channel", "value", F.lit(0).cast("bigint").alias("_ord"),
        (F.datediff("date", day0) * 1440 + F.col("pos")).cast("bigint").alias("_abs"))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    lo = F.ceil(F.timestamp_diff("SECOND", origin, F.col("start_ts")) / 60) - start_minute
    hi = F.ceil(F.timestamp_diff("SECOND", origin, F.col("end_ts")) / 60) - 1 - start_minute
    b = intervals.select(subject, "channel", "value", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"),
                         F.timestamp_diff("SECOND", origin, F.col("start_ts")).alias("_ord")).where("_hi >= _lo")
    b = b.select(subject, "channel", "value", "_ord", F.explode(F.sequence("_lo", "_hi")).alias("_abs"))
    both = a.unionByName(b)
    # At equal order the larger value wins, so the result is a function of the data alone.
    kept = both.groupBy(subject, "_abs", "channel").agg(F.max(F.struct("_ord", "value")).alias("m"))
    day = F.floor(F.col("_abs") / 1440).cast("int")
    return kept.select(subject, F.date_add(day0, day).alias("date"), F.pmod("_abs", F.lit(1440)).alias("minute"),
                       "channel", F.col("m.value").alias("value"))


def adjacent_days(df: DataFrame, subject: str, date: str, value: str) -> DataFrame:
    """(t, t+1) pairs of consecutive calendar days."""
    w = Window.partitionBy(subject).orderBy(date)
    return df.withColumns({"_pd": F.lag(date).over(w), "prev": F.lag(value).over(w)}).where(
        F.datediff(date, "_pd") == 1).drop("_pd")
