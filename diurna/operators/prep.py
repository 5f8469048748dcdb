"""Fold-local preprocessing: fit on train rows, apply to every row.

A fit aggregates to one row of parameters (columns ``<feature>__<name>``), whose width is the
schema's; applying it is a plain projection, so the data is not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.functions.numbers import signed_log
from diurna.operators.radix import filled_stats, interpolated, quantiles_by_column
from diurna.operators.ranking import one_row


def moment_params(train: DataFrame, columns) -> DataFrame:
    """Mean and population sd; a zero sd becomes 1."""
    sd = "CASE WHEN stddev_pop(`{0}`) > 1e-12 THEN stddev_pop(`{0}`) ELSE 1D END"
    return train.agg(*[F.expr(e) for c in columns for e in (f"avg(`{c}`) AS `{c}__mu`", f"{sd.format(c)} AS `{c}__sd`")])


def apply(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Project with SQL expressions that hold the fitted values as literals.

    Later steps then read the table once instead of repeating the fits before them.
    """
    return df.select(*[F.expr(exprs[c]).alias(c) if c in exprs else F.col(c) for c in df.columns])


def number(v: float | None) -> str:
    """A double literal; nulls stay null."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    return f"{v!r}D" if math.isfinite(v) else f"DOUBLE('{v}')"


def quantile_params(train: DataFrame, columns, names: dict[str, float]) -> dict[str, float | None]:
    """Exact quantiles ``<column>__<name>`` of all columns by one radix selection."""
    found = quantiles_by_column(train, [], columns, names)
    return {f"{c}__{n}": found[(), c][n] if ((), c) in found else None for c in columns for n in names}


def median_impute(df: DataFrame, train: DataFrame, columns) -> DataFrame:
    params = quantile_params(train, columns, {"med": 0.5})
    return apply(df, {c: f"coalesce(`{c}`, {number(params[f'{c}__med'])}, 0D)" for c in columns})


def standard_scale(df: DataFrame, train: DataFrame, columns) -> DataFrame:
    v = moment_params(train, columns).first().asDict()
    return apply(df, {c: f"(`{c}` - {number(v[f'{c}__mu'])}) / {number(v[f'{c}__sd'])}" for c in columns})


def minmax_scale(df: DataFrame, train: DataFrame, columns, pad: float = -1.0) -> DataFrame:
    """Train minimum and maximum ignoring padding, result in [0, 1]; padding stays."""
    real = {c: F.when(F.col(c) != pad, F.col(c)) for c in columns}
    params = train.agg(*[e for c in columns for e in (F.min(real[c]).alias(f"{c}__lo"), F.max(real[c]).alias(f"{c}__hi"))])

    v = params.first().asDict()

    def scaled(c):
        lo, hi = v[f"{c}__lo"], v[f"{c}__hi"]
        if lo is None or not hi > lo:
            inner = f"CASE WHEN `{c}` IS NOT NULL THEN 0D END"
        else:
            inner = f"CASE WHEN `{c}` IS NOT NULL THEN greatest(least((`{c}` - {number(lo)}) / {number(hi - lo)}, 1D), 0D) END"
        return f"CASE WHEN `{c}` = {number(float(pad))} THEN {number(float(pad))} ELSE {inner} END"

    return apply(df, {c: scaled(c) for c in columns})


def robust_scale(df: DataFrame, train: DataFrame, columns) -> DataFrame:
    params = quantile_params(train, columns, {"q1": 0.25, "med": 0.5, "q3": 0.75})

    def scaled(c):
        q1, med, q3 = (params[f"{c}__{k}"] for k in ("q1", "med", "q3"))
        return f"(`{c}` - {number(med)}) / {number(q3 - q1 if q3 is not None and q3 > q1 else 1.0)}"

    return apply(df, {c: scaled(c) for c in columns})


def fill_and_clip(frames, train: DataFrame, columns, low: float, high: float, more: dict[str, float] | None = None) -> tuple[list[DataFrame], dict[str, dict]]:
    """Median fill and clip to the quantiles that the filled train rows have, all from one selection over the raw train rows.

    Returns the frames and, per column, the clipped order statistics around the quantiles in ``more``.
    """
    stats = filled_stats(train, columns, {"lo": low, "hi": high} | (more or {}))
    exprs, kept = {}, {}
    for c in columns:
        s = stats.get(c, {"fill": 0.0, "n": 0})
        ends = {k: interpolated(s.get(f"{k}.lo"), s.get(f"{k}.hi"), s["n"], q) for k, q in (("lo", low), ("hi", high))}
        filled = f"coalesce(`{c}`, {number(s['fill'])})"
        exprs[c] = filled if s["n"] == 0 else f"greatest(least({filled}, {number(ends['hi'])}), {number(ends['lo'])})"
        # clipping keeps the order, so the clipped order statistics are those of the clipped rows
        kept[c] = {"n": s["n"]} | {f"{k}.{end}": None if s["n"] == 0 else min(max(s[f"{k}.{end}"], ends["lo"]), ends["hi"]) for k in more or {} for end in ("lo", "hi")}
    return [apply(f, exprs) for f in frames], kept


def winsorise(df: DataFrame, train: DataFrame, columns, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Median fill, clip to train quantiles, then z-score; every statistic from train rows."""
    (d, tr), _ = fill_and_clip([df, train], train, columns, low, high)
    return standard_scale(d, tr, columns)


def signed_log_scale(df: DataFrame, train: DataFrame, columns, heavy, low: float = 0.01, high: float = 0.99, eps: float = 1e-8) -> DataFrame:
    """Signed log on the allow-listed columns, median fill, clip, (x - median) / IQR with sd and 1 as fallbacks."""
    logs = {c: signed_log(F.col(c)) for c in heavy}
    d, tr = df.withColumns(logs), train.withColumns(logs)
    names = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    (d, tr), kept = fill_and_clip([d, tr], tr, columns, low, high, names)
    params = tr.agg(*[F.stddev_pop(c).alias(f"{c}__sd") for c in columns]).first().asDict()
    params |= {f"{c}__{k}": interpolated(s[f"{k}.lo"], s[f"{k}.hi"], s["n"], q) for c, s in kept.items() for k, q in names.items()}

    def scaled(c):
        q1, q3, sd = (params[f"{c}__{k}"] for k in ("q1", "q3", "sd"))
        iqr = None if q3 is None else q3 - q1
        unit = iqr if iqr is not None and iqr >= eps else sd if sd is not None and sd >= eps else 1.0
        return f"(`{c}` - {number(params[f'{c}__med'])}) / {number(unit)}"

    return apply(d, {c: scaled(c) for c in columns})


def subject_moments(long: DataFrame, subject: str, channel: str, value: str) -> DataFrame:
    """Per-subject count, sum and sum of squares; any fold's mean and sd is a sum over its subjects."""
    v = F.col(value)
    return long.groupBy(subject, channel).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))


def fold_moments(partials: DataFrame, membership: DataFrame, subject: str, channel: str, fold: str) -> DataFrame:
    j = partials.join(membership, subject)
    g = j.groupBy(fold, channel).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    mean = F.try_divide("s1", "n")
    return g.select(fold, channel, "n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("s2", "n") - mean * mean, F.lit(0.0))).alias("sd"))


def scope_record(fitted: DataFrame, scored: DataFrame, subject: str) -> DataFrame:
    """Order-free digest of the fitted subjects and their overlap with the scored ones."""
    h = F.conv(F.substring(F.md5(F.col(subject)), 1, 15), 16, 10).cast("bigint")
    f = fitted.select(subject).distinct()
    rec = f.agg(F.count("*").alias("n_fitted"), F.bit_xor(h).alias("digest"))
    hit = scored.select(subject).distinct().join(f, subject, "left_semi").agg(F.count("*").alias("n_scored_and_fitted"))
    return rec.transform(one_row, hit)
