"""Column rules, row predicates and outlier rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions.numbers import clip, to_number
from diurna.operators.ranking import one_row, quantiles
from diurna.sources.carriers import stack_columns


def forbidden_reason(name: Column, exact=(), substrings=(), tokens=(), patterns=()) -> Column:
    """Why a column name may not be a feature; NULL when it may."""
    low = F.lower(name)
    words = F.split(low, "[^a-z0-9]+")
    reasons = [F.when(low.isin(*[e.lower() for e in exact]), "exact") if exact else F.lit(None)]
    reasons += [F.when(F.contains(low, F.lit(s)), "substring") for s in substrings]
    if tokens:
        reasons.append(F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in tokens])), "token"))
    reasons += [F.when(low.rlike(p), "pattern") for p in patterns]
    return F.coalesce(*reasons)


def column_facts(df: DataFrame, columns, stats: dict) -> DataFrame:
    """One wide aggregation, returned as one row per column."""
    wide = df.agg(*[F.struct(*[f(F.col(c)).alias(k) for k, f in stats.items()]).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), *[F.col(c)[k].alias(k) for k in stats]) for c in columns])))


def sequence_like(df: DataFrame, columns, threshold: float = 0.05) -> DataFrame:
    share = lambda c: F.avg(c.rlike(r"[/,\[\]{}]").cast("double"))
    return column_facts(df, columns, {"share": share}).withColumn("is_sequence", F.col("share") > threshold)


def numeric_columns(df: DataFrame, columns, min_share: float = 0.5, few_share: float = 0.01, few: int = 5) -> DataFrame:
    """``keep``: at least ``min_share`` of the rows are numbers; ``keep_few``: at least ``few`` rows and ``few_share`` of them, rounded up, are."""
    known = lambda c: to_number(c.cast("string")).isNotNull()
    facts = column_facts(df, columns, {"share": lambda c: F.avg(known(c).cast("double")), "n_numeric": lambda c: F.sum(known(c).cast("bigint")), "n_rows": lambda c: F.count(F.lit(1))})
    return facts.withColumns({"keep": F.col("share") >= min_share, "keep_few": F.col("n_numeric") >= F.greatest(F.lit(few), F.ceil(F.col("n_rows") * F.lit(few_share)))})


def varying_columns(df: DataFrame, columns) -> DataFrame:
    """keep = more than one distinct known value; min and max combine map-side, distinct sets do not."""
    return column_facts(df, columns, {"lo": F.min, "hi": F.max}).select(
        "name", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("keep"))


def degenerate_columns(df: DataFrame, columns) -> DataFrame:
    return column_facts(df, columns, {"present": lambda c: F.count(c) / F.count("*"), "spread": F.stddev_pop}).withColumn(
        "drop", (F.col("present") == 0) | (F.coalesce("spread", F.lit(0.0)) <= 1e-12))


def missing_share(df: DataFrame, columns, limit: float = 0.5) -> DataFrame:
    return column_facts(df, columns, {"missing": lambda c: F.avg(c.isNull().cast("double"))}).withColumn(
        "drop", F.col("missing") >= limit)


def domain_or_null(item: Column, allowed) -> Column:
    return F.when(item.isin(*allowed), item)


def min_observations(df: DataFrame, subject: str, n: int) -> DataFrame:
    """Counts combine map-side; the big side is then semi-joined, so no per-subject window is needed."""
    enough = df.groupBy(subject).agg(F.count("*").alias("_n")).where(F.col("_n") >= n)
    return df.join(enough, subject, "left_semi")


def bounds(df: DataFrame, columns, q: float, by=()) -> DataFrame:
    """Exact [q, 1-q] bounds, one row per group with columns lo_<c>, hi_<c>."""
    long = stack_columns(df, list(by), columns, "feature")
    lo, hi = quantiles(long, [*by, "feature"], "value", [q, 1 - q]).columns[-2:]
    b = quantiles(long, [*by, "feature"], "value", [q, 1 - q])
    return b.groupBy(*by).agg(*[e for c in columns for e in (
        F.max(F.when(F.col("feature") == c, F.col(lo))).alias(f"lo_{c}"),
        F.max(F.when(F.col("feature") == c, F.col(hi))).alias(f"hi_{c}"))])


def attach_bounds(df: DataFrame, b: DataFrame, by=()) -> DataFrame:
    """Without a group the bounds are a single row; with one the optimizer picks the join."""
    return df.join(b, list(by), "left") if by else df.transform(one_row, b)


def drop_outliers(df: DataFrame, columns, q: float, by=()) -> DataFrame:
    inside = reduce(lambda x, y: x & y, [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns])
    return attach_bounds(df, bounds(df, columns, q, by), by).where(inside).select(*df.columns)


def clip_outliers(df: DataFrame, columns, q: float, by=()) -> DataFrame:
    """Clipped columns and the number of cells changed in the row."""
    j = attach_bounds(df, bounds(df, columns, q, by), by)
    new = {c: clip(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns}
    changed = reduce(lambda x, y: x + y, [(~F.col(c).eqNullSafe(e)).cast("int") for c, e in new.items()])
    keep = [new[c].alias(c) if c in new else F.col(c) for c in df.columns]
    return j.select(*keep, changed.alias("n_clipped"))


def retention_scan(df: DataFrame, columns, qs, label: str) -> DataFrame:
    """Rows kept per class for each q, in one pass over the rows."""
    long = stack_columns(df, [], columns, "feature")
    every = sorted({round(v, 6) for q in qs for v in (q, 1 - q)})
    b = quantiles(long, ["feature"], "value", every)
    names = dict(zip(every, b.columns[2:]))
    one = b.agg(*[F.max(F.when(F.col("feature") == c, F.col(n))).alias(f"{c}_{n}") for c in columns for n in names.values()])
    j = df.transform(one_row, one)

    def inside(q):
        lo, hi = names[round(q, 6)], names[round(1 - q, 6)]
        return reduce(lambda x, y: x & y, [F.col(c).between(F.col(f"{c}_{lo}"), F.col(f"{c}_{hi}")) for c in columns])

    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), inside(q).cast("int").alias("kept")) for q in qs])
    return j.select(label, F.inline(rows)).groupBy("q", label).agg(
        F.count("*").alias("n_before"), F.sum("kept").alias("n_kept"))
