"""Subject-level statistics over one value per calendar day.

Inputs of the array families are rows (subject, channel, days, wend, vals) with at most
one element per calendar day, so each array is bounded by the length of the study.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions import series as S
from diurna.functions.numbers import ratio
from diurna.operators.intraday import spectral_peak
from diurna.operators.ranking import one_row

EPS = 1e-8


def _gate(ok: Column, e: Column) -> Column:
    return F.when(ok, e)


def order_stats(o: Column, **names) -> dict[str, Column]:
    """Quantiles of an already sorted array column."""
    return {k: F.when(F.size(o) > 0, S.quantile(o, q)) for k, q in names.items()}


def autocorrelation(v: Column, min_n: int = 4) -> Column:
    """Lag-1 autocorrelation around the overall mean."""
    c = S.let(S.mean(v), lambda m: F.transform(v, lambda x: x - m))
    return S.let(c, lambda z: S.let(S.total(F.transform(z, lambda x: x * x)), lambda d: F.when(
        (F.size(z) >= min_n) & (d > 1e-12), S.total(S.adjacent(z, lambda x, y: x * y)) / d)))


def tail_mean(v: Column, k: Column) -> Column:
    return S.mean(F.slice(v, F.greatest(F.size(v) - k + 1, F.lit(1)), F.greatest(k, F.lit(0))))


def thirds_gap(v: Column, min_n: int = 6) -> Column:
    """Mean of the last third minus mean of the first third of known values."""
    third = F.greatest((F.size(v) / 3).cast("int"), F.lit(1))
    return F.when(F.size(v) >= min_n, tail_mean(v, third) - S.mean(F.slice(v, 1, third)))


def weekend_gap(vals: Column, wend: Column, min_n: int) -> Column:
    def part(flag):
        return S.known(F.zip_with(vals, wend, lambda x, w: F.when(w == flag, x)))

    return S.let(part(1), lambda a: S.let(part(0), lambda b: F.when(
        (F.size(a) >= min_n) & (F.size(b) >= min_n), S.mean(a) - S.mean(b))))


def staged(df: DataFrame, vals: str = "vals") -> DataFrame:
    """Adds v (known values in day order) and o (known values sorted), computed once per row."""
    return df.withColumns({"v": S.known(F.col(vals)), "o": S.ordered(F.col(vals))})


def rich_stats(df: DataFrame, keys) -> DataFrame:
    """Eighteen statistics of a daily channel."""
    d = staged(df).withColumns({"m": S.mean(F.col("v")), "s": S.sd(F.col("v"))})
    v, o, m, s, n = F.col("v"), F.col("o"), F.col("m"), F.col("s"), F.size("v")
    cols = {
        "mean": m, **order_stats(o, median=0.5, q25=0.25, q75=0.75), "std": s, "cv": ratio(s, F.abs(m)),
        "min": F.array_min(v), "max": F.array_max(v), "range": F.array_max(v) - F.array_min(v),
        "skew": S.skewness(v), "kurt": S.kurtosis(v), "slope": S.slope(F.col("vals")),
        "late_minus_early": thirds_gap(v),
        "recent_ratio": F.when((n >= 10) & (F.abs(m) > 1e-12), tail_mean(v, F.least(F.lit(14), n)) / m),
        "roll7_std": F.when(n >= 7, S.mean(S.rolling(F.col("vals"), 7, S.sd, 4))),
        "acf1": autocorrelation(v), "weekend_delta": weekend_gap(F.col("vals"), F.col("wend"), 3)}
    return d.select(*keys, *[e.alias(k) for k, e in cols.items()]).withColumn("iqr", F.col("q75") - F.col("q25"))


def lite_stats(long: DataFrame, keys, value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn(
        "cv", ratio(F.col("std"), F.abs("mean")))


def variability_family(df: DataFrame, keys, window: int = 7, bins: int = 4) -> DataFrame:
    """Seventeen level, spread and time-ordered variability statistics of the known values."""
    d = staged(df).withColumns({"m": S.mean(F.col("v")), "s": S.sd(F.col("v"), 1)})
    v, o, m, s, n = F.col("v"), F.col("o"), F.col("m"), F.col("s"), F.size("v")
    width = (n / bins).cast("int")
    bm = F.when(n >= bins, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: S.mean(F.slice(v, i * width + 1, width))))
    # the smallest of the most frequent values after rounding to one decimal
    rounded = F.sort_array(F.transform(v, lambda x: F.bround(x, 1)))
    win_sd = S.full_windows(v, window, lambda w: S.sd(w, 1))
    win_cv = S.full_windows(v, window, lambda w: S.sd(w, 1) / (F.abs(S.mean(w)) + EPS))
    cols = {
        "mean": m, **order_stats(o, median=0.5, q25=0.25, q75=0.75), "trimmed_mean": S.trimmed_mean(v, 0.1), "mode": S.first_mode(rounded),
        "min": F.array_min(v), "max": F.array_max(v), "mad": S.mean_abs_deviation(v), "kurtosis": S.kurtosis(v, 4),
        "range": F.array_max(v) - F.array_min(v), "sd": s, "cv": s / (F.abs(m) + EPS), "stv": S.mean(win_sd), "tbv": S.var(bm, 1),
        "rcv": S.mean(win_cv), "mr": S.mean(F.transform(S.differences(v), F.abs)), "tbcr": S.mean(F.transform(S.differences(bm), F.abs))}
    return d.select(*keys, *[_gate(n >= 3, e).alias(k) for k, e in cols.items()]).withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def array_split(a: Column, parts: int) -> Column:
    """Consecutive parts whose sizes differ by at most one, longer parts first."""
    def body(v):
        q = (F.size(v) / parts).cast("int")
        r = F.size(v) % parts
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(
            v, i * q + F.least(i, r) + 1, q + F.when(i < r, 1).otherwise(0)))

    return S.let(a, body)


def histogram_mode(v: Column) -> Column:
    """Centre of the fullest of ceil(sqrt(n)) (3 to 10) equal-width bins; median for short or constant input."""
    def body(x):
        bins = F.greatest(F.least(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(10)), F.lit(3))
        lo, hi = F.array_min(x), F.array_max(x)

        def pick(z):
            idx = F.transform(x, lambda e: F.least(F.floor((e - z["lo"]) / (z["hi"] - z["lo"]) * z["b"]).cast("int"), z["b"] - 1))
            counts = S.let(idx, lambda k: F.transform(F.sequence(F.lit(0), z["b"] - 1), lambda j: F.size(F.filter(k, lambda e: e == j))))
            return S.let(counts, lambda c: z["lo"] + (F.array_position(c, F.array_max(c)) - 0.5) * (z["hi"] - z["lo"]) / z["b"])

        return F.when(F.size(x) == 0, F.lit(None)).when((F.size(x) < 4) | (lo == hi), S.median(x)).otherwise(
            S.let(F.struct(lo.alias("lo"), hi.alias("hi"), bins.alias("b")), pick))

    return S.let(v, body)


def on_calendar(days: Column, vals: Column, anchor: Column, width: int) -> Column:
    """Values on every calendar day of (anchor - width, anchor]; unseen days are NULL."""
    keep = F.filter(F.arrays_zip(days.alias("d"), vals.alias("v")), lambda p: (p["d"] > anchor - width) & (p["d"] <= anchor))
    return S.let(keep, lambda p: S.densify(
        F.transform(p, lambda q: q["d"] - (anchor - width + 1)), F.transform(p, lambda q: q["v"]), width))


def compact_variability(df: DataFrame, keys, width: int = 35) -> DataFrame:
    """Twenty-two statistics over the last ``width`` calendar days of each series."""
    d = df.withColumn("g", on_calendar(F.col("days"), F.col("vals"), F.array_max("days"), width))
    d = staged(d, "g").withColumns({"m": S.mean(F.col("v")), "s": S.sd(F.col("v"))})
    g, v, o, m, s, n = F.col("g"), F.col("v"), F.col("o"), F.col("m"), F.col("s"), F.size("v")
    step = S.known(F.transform(S.differences(g), F.abs))
    bins = F.transform(array_split(g, 4), S.mean)
    cols = {
        "valid_day_ratio": n / F.lit(float(width)), "mean": m, **order_stats(o, median=0.5, q25=0.25, q75=0.75),
        "trimmed_mean_10": F.when(n >= 5, S.trimmed_mean(v, 0.1)).otherwise(m), "robust_mode": histogram_mode(v),
        "min": F.array_min(v), "max": F.array_max(v), "median_abs_deviation": S.median_abs_deviation(v),
        "mean_abs_deviation": S.mean_abs_deviation(v), "kurtosis": F.when(s > 0, S.kurtosis_unbiased(v)), "range": F.array_max(v) - F.array_min(v),
        "std": s, "cv": s / (F.abs(m) + 1e-6), "short_term_variability": S.median(step), "moving_range_mean": S.mean(step),
        "rolling7_sd_mean": S.mean(S.rolling(g, 7, S.sd, 3)), "rolling7_cv_mean": S.mean(S.rolling(g, 7, lambda w: S.sd(w) / (F.abs(S.mean(w)) + 1e-6), 3)),
        "timebin_mean_std": S.let(bins, lambda b: F.when(F.size(S.known(b)) >= 2, S.sd(b))),
        "timebin_mean_range": S.let(bins, lambda b: F.when(F.size(S.known(b)) >= 2, F.array_max(b) - F.array_min(b))),
        "timebin_last_minus_first": S.let(bins, lambda b: F.get(b, F.lit(3)) - F.get(b, F.lit(0)))}
    return d.select(*keys, *[e.alias(k) for k, e in cols.items()]).withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def event_summary(df: DataFrame, keys, last: int = 28) -> DataFrame:
    """Eight robust statistics of the last ``last`` events; the slope pairs at most last*(last-1)/2 points."""
    d = df.withColumn("e", F.slice("vals", F.greatest(F.size("vals") - last + 1, F.lit(1)), last))
    d = staged(d, "e")
    # ranks of known values keep their positions among all events
    pos = F.filter(S.positions(F.size("e")), lambda i: F.get("e", i).isNotNull())
    d = d.withColumn("p", pos)

    def slopes(z):
        ks = S.positions(F.size(z["v"]))
        return F.flatten(F.transform(ks, lambda i: F.transform(F.filter(ks, lambda j: j > i), lambda j: (
            F.get(z["v"], j) - F.get(z["v"], i)) / (F.get(z["p"], j) - F.get(z["p"], i)))))

    half = F.ceil(F.size("e") / 2).cast("int")
    v, o = F.col("v"), F.col("o")
    cols = {
        **order_stats(o, median=0.5, p10=0.1, p90=0.9, q25=0.25, q75=0.75), "trimmed_mean_10": S.trimmed_mean(v, 0.1),
        "mad": S.median_abs_deviation(v),
        "theil_sen": F.when(F.size(v) >= 3, S.median(S.let(F.struct("v", "p"), slopes))),
        "late_minus_early_half": F.when(F.size("e") >= 2, S.median(F.slice("e", half + 1, F.greatest(F.size("e"), F.lit(1)))) - S.median(F.slice("e", 1, half)))}
    return d.select(*keys, *[e.alias(k) for k, e in cols.items()]).withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def biological_stats(df: DataFrame, keys) -> DataFrame:
    """Twenty-two statistics; positions run over all days of the series, known or not."""
    d = staged(df).withColumns({"m": S.mean(F.col("v")), "s": S.sd(F.col("v")), "fill": S.interpolate(F.col("vals"))})
    vals, v, o, m, s, n = F.col("vals"), F.col("v"), F.col("o"), F.col("m"), F.col("s"), F.size("v")
    recent = S.mean(F.slice(vals, F.greatest(F.size(vals) - 6, F.lit(1)), 7))
    scale = F.size(vals) - 1
    cols = {
        "mean": m, **order_stats(o, median=0.5, p10=0.1, p25=0.25, p75=0.75, p90=0.9), "std": s, "min": F.array_min(v), "max": F.array_max(v),
        "range": F.array_max(v) - F.array_min(v), "cv": ratio(s, F.abs(m)),
        "skew": F.when(n >= 3, F.coalesce(S.skewness(v), F.lit(0.0))), "kurtosis": F.when(n >= 4, F.coalesce(S.kurtosis(v), F.lit(-3.0))),
        "first_last_delta": F.element_at(v, -1) - F.get(v, F.lit(0)),
        "rank_slope": S.slope(vals, F.transform(S.positions(F.size(vals)), lambda i: i / F.greatest(scale, F.lit(1)))),
        "recent7_minus_all": recent - m, "recent7_to_all_ratio": F.when(F.abs(m) > 1e-12, recent / m),
        "autocorr1": S.acf1(vals, 4), "entropy": S.quantile_entropy(vals), "spectral_peak_ratio": spectral_peak(F.col("fill"), n),
        "rolling7_variability": F.when(F.size(vals) >= 3, S.mean(S.rolling(vals, 7, S.sd, 3)))}
    out = d.select(*keys, *[_gate(n > 0, e).alias(k) for k, e in cols.items()])
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def protocol_stats(df: DataFrame, keys) -> DataFrame:
    vals = F.col("vals")
    missing = F.transform(vals, lambda x: x.isNull())
    return df.select(*keys, F.size(vals).alias("length"), F.size(S.known(vals)).alias("valid_days"),
                     S.share(missing, lambda x: x).alias("missing_fraction"), S.longest_run(missing, lambda x: x).alias("longest_missing_run"))


def lookback_stats(repeated: DataFrame, keys, value: str, width: str, age: Column) -> DataFrame:
    """Statistics of rows already repeated per look-back width (see joins.lookbacks)."""
    x = F.when(F.col(value).isNotNull(), (F.col(width) - 1 - age) / F.greatest(F.col(width) - 1, F.lit(1)))
    n = F.count(value)
    g = repeated.groupBy(*keys, width).agg(
        (n / F.first(width)).alias("valid_day_ratio"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.percentile(value, F.lit(q)).alias(k) for k, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75), ("p10", 0.1), ("p90", 0.9))],
        F.when((n >= 3) & (F.min(x) < F.max(x)), F.regr_slope(F.col(value), x)).alias("slope"))
    return g.withColumn("iqr", F.col("q75") - F.col("q25")).drop("q25", "q75")


def payload_stats(df: DataFrame, keys, digits: int = 4) -> DataFrame:
    """Rounded (half to even) summary of a channel with trend per week and gap contrasts."""
    d = staged(df).withColumn("m", S.mean(F.col("v")))
    vals, v, o, m, n = F.col("vals"), F.col("v"), F.col("o"), F.col("m"), F.size("v")
    s = F.when(n > 1, S.sd(v, 1)).otherwise(0.0)
    cols = {
        "missing_rate": 1 - n / F.greatest(F.size(vals), F.lit(1)), "mean": m, "sd": _gate(n > 0, s), "cv": _gate(n > 0, ratio(s, F.abs(m), 1e-9)),
        **order_stats(o, median=0.5, p10=0.1, p90=0.9), "iqr": F.when(n > 0, S.quantile(o, 0.75) - S.quantile(o, 0.25)),
        "min": F.array_min(v), "max": F.array_max(v), "trend_per_week": S.slope(vals, F.col("days")) * 7, "late_minus_early": thirds_gap(v),
        "weekend_minus_weekday": weekend_gap(vals, F.col("wend"), 2)}
    return d.select(*keys, n.alias("n_valid"), *[F.bround(e, digits).alias(k) for k, e in cols.items()])


def circular_stats(df: DataFrame, keys, hour: str) -> DataFrame:
    """Circular mean hour and circular sd from partial sums of sine and cosine."""
    a = F.col(hour) * (2 * math.pi / 24)
    g = df.groupBy(*keys).agg(F.avg(F.sin(a)).alias("_s"), F.avg(F.cos(a)).alias("_c"), F.count(hour).alias("n_valid"))
    r = F.hypot("_s", "_c")
    return g.select(
        *keys, "n_valid", (F.pmod(F.atan2("_s", "_c"), F.lit(2 * math.pi)) * (24 / (2 * math.pi))).alias("mean_hour"),
        F.when((F.col("n_valid") >= 2) & (r > 1e-12), F.sqrt(-2 * F.log(F.least(r, F.lit(1.0)))) * (24 / (2 * math.pi))).alias("sd_hours"))


def stability_variability(cells: DataFrame, subject: str) -> DataFrame:
    """Interdaily stability and intradaily variability of (subject, date, hour, value) cells.

    Successive differences run over the flattened day-by-hour order, so they cross midnight
    and unrecorded days; a difference needs both cells. Cells per subject are bounded by
    24 per recorded day.
    """
    w = Window.partitionBy(subject)
    order = w.orderBy("_cell")
    d = cells.withColumns({"_gm": F.avg("value").over(w), "_day": F.dense_rank().over(w.orderBy("date"))})
    d = d.withColumn("_cell", F.col("_day") * 24 + F.col("hour"))
    d = d.withColumn("_step", F.when(F.col("_cell") - F.lag("_cell").over(order) == 1, F.col("value") - F.lag("value").over(order)))
    by_hour = d.groupBy(subject, "hour").agg(
        F.avg("value").alias("_hm"), F.count("value").alias("_n"), F.sum(F.pow(F.col("value") - F.col("_gm"), 2)).alias("_tot"),
        F.coalesce(F.sum(F.pow("_step", F.lit(2.0))), F.lit(0.0)).alias("_suc"), F.first("_gm").alias("_gm"))
    g = by_hour.groupBy(subject).agg(
        F.sum("_n").alias("n_points"), F.sum(F.pow(F.col("_hm") - F.col("_gm"), 2)).alias("_b"), F.sum("_tot").alias("_tot"), F.sum("_suc").alias("_suc"))
    ok = F.col("_tot") > 1e-12
    return g.select(subject, "n_points", F.when(ok, F.col("n_points") * F.col("_b") / (24 * F.col("_tot"))).alias("is_value"),
                    F.when(ok & (F.col("n_points") > 1), F.col("n_points") * F.col("_suc") / ((F.col("n_points") - 1) * F.col("_tot"))).alias("iv_value"))


def sleep_regularity(episodes: DataFrame, subject: str, start: str, end: str, epoch_minutes: int = 5) -> DataFrame:
    """Agreement of the sleep state at the same epoch on adjacent days, -100 to 100.

    Only slept epochs are materialised. Agreement of days d and d+1 is the number of epochs
    minus those slept on exactly one of the two; each slept epoch is counted once for either pair.
    """
    per_day = 1440 // epoch_minutes
    sec = epoch_minutes * 60
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    s, e = F.timestamp_diff("SECOND", origin, F.col(start)), F.timestamp_diff("SECOND", origin, F.col(end))
    base = episodes.where(e > s).select(subject, s.alias("_s"), e.alias("_e"))
    span = base.groupBy(subject).agg(F.floor(F.min("_s") / 86400).alias("_d0"), F.ceil(F.max("_e") / 86400).alias("_d1"))
    lo, hi = F.floor(F.col("_s") / sec), F.floor(F.col("_e") / sec) - 1
    slept = base.where(hi >= lo).select(subject, F.explode(F.sequence(lo, hi)).alias("_ep")).distinct()
    day, slot = F.floor(F.col("_ep") / per_day), F.pmod("_ep", F.lit(per_day))
    pairs = slept.select(subject, slot.alias("_slot"), F.explode(F.array(day, day - 1)).alias("_pair"))
    twice = pairs.groupBy(subject, "_pair", "_slot").agg(F.count("*").alias("_k"))
    odd = twice.groupBy(subject, "_pair").agg(F.sum((F.col("_k") == 1).cast("int")).alias("_odd"))
    grid = span.where("_d1 - _d0 >= 2").select(subject, "_d0", F.explode(F.sequence(F.col("_d0"), F.col("_d1") - 2)).alias("_pair"))
    return grid.join(odd, [subject, "_pair"], "left").select(
        subject, (F.col("_pair") - F.col("_d0")).alias("pair_index"),
        (-100 + 200 * (per_day - F.coalesce("_odd", F.lit(0))) / F.lit(float(per_day))).alias("sri"))


def coverage(df: DataFrame, subject: str, date: str) -> DataFrame:
    """Rows, days, span, coverage, duplicates, first-day offset and gaps per subject."""
    per_day = df.groupBy(subject, date).agg(F.count("*").alias("_r"))
    w = Window.partitionBy(subject).orderBy(date)
    g = per_day.withColumn("_gap", F.datediff(date, F.lag(date).over(w))).groupBy(subject).agg(
        F.sum("_r").alias("rows"), F.count("*").alias("days"), F.min(date).alias("_a"), F.max(date).alias("_b"),
        F.max("_gap").alias("max_gap"), F.avg("_gap").alias("mean_gap"))
    first = df.agg(F.min(date).alias("_origin"))
    g = g.transform(one_row, first)  # one row
    span = F.datediff("_b", "_a") + 1
    return g.select(subject, "rows", "days", span.alias("span"), (F.col("days") / span).alias("coverage"),
                    (F.col("rows") - F.col("days")).alias("duplicates"), F.datediff("_a", "_origin").alias("first_offset"), "max_gap", "mean_gap")


def detrended_sd(long: DataFrame, keys, x: str, y: str, min_n: int = 8) -> DataFrame:
    """Population sd of the residuals of a linear fit, in closed form from second moments."""
    ok = F.col(y).isNotNull()
    xx, yy = F.when(ok, F.col(x)), F.col(y)
    return long.groupBy(*keys).agg(F.count(y).alias("n"), F.var_pop(xx).alias("_vx"), F.var_pop(yy).alias("_vy"), F.covar_pop(xx, yy).alias("_c")).select(
        *keys, "n", F.when((F.col("n") >= min_n) & (F.col("_vx") > 0), F.sqrt(F.greatest(
            F.col("_vy") - F.col("_c") * F.col("_c") / F.col("_vx"), F.lit(0.0)))).alias("sd"))


# Item names of the instrument by domain.
DOMAINS = {
    "orient_time": ("Q01", "Q02", "Q03", "Q04", "Q05"),
    "orient_place": ("Q06", "Q07", "Q08", "Q09", "Q10"),
    "registration": ("Q11_1", "Q11_2", "Q11_3"),
    "attention": ("Q12_1", "Q12_2", "Q12_3", "Q12_4", "Q12_5"),
    "recall": ("Q13_1", "Q13_2", "Q13_3"),
    "language": ("Q14_1", "Q14_2", "Q15", "Q16_1", "Q16_2", "Q16_3", "Q17", "Q18", "Q19"),
}
ITEMS = tuple(i for d in DOMAINS.values() for i in d)


def instrument_scores(df: DataFrame, keep) -> DataFrame:
    """Domain sums of passed items (1 fail, 2 pass, other missing), deficits, shares and cut-off flags."""
    item = {i: F.when(F.col(i).isin(1, 2), F.col(i) - 1) for i in ITEMS}
    none = F.coalesce(*item.values()).isNull()

    def added(items):
        return F.when(~none, F.aggregate(F.array(*[F.coalesce(item[i], F.lit(0)) for i in items]), F.lit(0), lambda s, x: s + x.cast("int")))

    dom = {k: added(v) for k, v in DOMAINS.items()}
    total = added(ITEMS)
    return df.select(
        *keep, *[e.alias(k) for k, e in dom.items()], total.alias("total"),
        (F.lit(len(DOMAINS["recall"])) - dom["recall"]).alias("recall_deficit"),
        (total / F.lit(float(len(ITEMS)))).alias("pass_share"), (F.lit(len(ITEMS)) - total).alias("total_deficit"),
        (total < 24).cast("int").alias("below_24"), (total < 27).cast("int").alias("below_27"),
        (dom["orient_time"] + dom["orient_place"] < 10).cast("int").alias("orientation_error"))
