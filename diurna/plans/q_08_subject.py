"""Aggregation of days to subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.functions import clock as C
from diurna.functions import series as S
from diurna.functions.hashing import hash_int
from diurna.functions.numbers import correlation
from diurna.operators import joins as J
from diurna.operators import subject as U
from diurna.operators.ranking import spearman
from diurna.plans.carrier_sql import h
from diurna.plans.registry import query
from diurna.sources.carriers import stack_columns

K = ["subject_id", "channel"]
G = "GROUP BY subject_id, channel"
P = "PARTITION BY subject_id, channel"


def on(*names):
    """LEFT JOIN chain of (subject, channel) tables onto every subject-channel."""
    return "FROM c_lk k " + " ".join(f"LEFT JOIN {n} ON {n}.subject_id = k.subject_id AND {n}.channel = k.channel" for n in names)


SLOPE = f"sl AS (SELECT subject_id, channel, CASE WHEN count(*) >= 3 THEN regr_slope(value, pos) END AS slope FROM c_lf {G})"
THIRDS = f"th AS (SELECT subject_id, channel, CASE WHEN max(nv) >= 6 THEN avg(value) FILTER (WHERE fpos >= nv - nv // 3) - avg(value) FILTER (WHERE fpos < nv // 3) END AS late_minus_early FROM c_lf {G})"
ACF = (f"ac AS (SELECT subject_id, channel, CASE WHEN count(*) >= 4 AND sum(c * c) > 1e-12 THEN sum(c * pc) / sum(c * c) END AS acf1 FROM (SELECT *, lag(c) OVER ({P} ORDER BY fpos) AS pc "
       f"FROM (SELECT *, value - avg(value) OVER ({P}) AS c FROM c_lf)) {G})")


def roll(name: str, k: int, width: int = 7, src: str = "c_lp", order: str = "pos", cond: str = "true") -> str:
    return (f"{name} AS (SELECT subject_id, channel, avg(sd) AS rsd, avg(sd / (abs(mu) + 1e-6)) AS rcv FROM (SELECT subject_id, channel, CASE WHEN count(value) OVER w >= {k} THEN stddev_pop(value) OVER w END AS sd, "
            f"avg(value) OVER w AS mu FROM {src} WINDOW w AS ({P} ORDER BY {order} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)) WHERE {cond} {G})")


def weekend(k: int) -> str:
    return (f"we AS (SELECT subject_id, channel, CASE WHEN count(*) FILTER (WHERE is_weekend = 1) >= {k} AND count(*) FILTER (WHERE is_weekend = 0) >= {k} "
            f"THEN avg(value) FILTER (WHERE is_weekend = 1) - avg(value) FILTER (WHERE is_weekend = 0) END AS weekend_delta FROM c_lf {G})")


@query("subject_mean_std", s="subject_id diag", i="n_days", f="act_mean_mean act_mean_std slp_mean_mean slp_mean_std act_n_mean slp_max_std", sql="""
    SELECT d.*, l.diag FROM (SELECT a.subject_id, count(*) AS n_days, avg(act_mean) AS act_mean_mean, coalesce(stddev_samp(act_mean), 0) AS act_mean_std, avg(slp_mean) AS slp_mean_mean,
      coalesce(stddev_samp(slp_mean), 0) AS slp_mean_std, avg(act_n) AS act_n_mean, coalesce(stddev_samp(slp_max), 0) AS slp_max_std
      FROM c_act a JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date GROUP BY 1) d LEFT JOIN c_subj l ON l.subject_id = d.subject_id""")
def _(t):
    j = J.join_modalities(t.activity, t.sleep)
    cols = ["act_mean", "slp_mean", "act_n", "slp_max"]
    g = j.groupBy("subject_id").agg(F.count("*").alias("n_days"), *[e for c in cols for e in (
        F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))])
    return J.join_labels(g, t.subjects.select("subject_id", "diag"), "subject_id", "diag")


RICH = "mean median std cv min max q25 q75 iqr range skew kurt slope late_minus_early recent_ratio roll7_std acf1 weekend_delta"


@query("subject_rich_stats", s="subject_id channel", f=RICH, sql=f"""
    WITH {SLOPE}, {THIRDS}, {ACF}, {roll('ro', 4)}, {weekend(3)},
    rr AS (SELECT subject_id, channel, CASE WHEN max(nv) >= 10 AND abs(avg(value)) > 1e-12 THEN avg(value) FILTER (WHERE fpos >= nv - 14) / avg(value) END AS recent_ratio FROM c_lf {G})
    SELECT k.subject_id, k.channel, m AS mean, med AS median, sqrt(m2) AS std, CASE WHEN abs(m) > 1e-12 THEN sqrt(m2) / abs(m) END AS cv, lo AS min, hi AS max, q25, q75, q75 - q25 AS iqr, hi - lo AS range,
      CASE WHEN nv >= 3 AND sqrt(m2) > 1e-12 THEN m3 / pow(m2, 1.5) END AS skew, CASE WHEN nv >= 3 AND sqrt(m2) > 1e-12 THEN m4 / (m2 * m2) - 3 END AS kurt,
      slope, late_minus_early, recent_ratio, CASE WHEN nv >= 7 THEN rsd END AS roll7_std, acf1, weekend_delta {on('c_mom', 'sl', 'th', 'ac', 'ro', 'we', 'rr')}""")
def _(t):
    return U.rich_stats(t.daily_arrays, K)


@query("subject_lite_stats", s="subject_id channel", f="mean std cv", sql=f"""
    SELECT subject_id, channel, avg(value) AS mean, stddev_pop(value) AS std, CASE WHEN abs(avg(value)) > 1e-12 THEN stddev_pop(value) / abs(avg(value)) END AS cv FROM c_long {G}""")
def _(t):
    return U.lite_stats(t.long, K)


@query("day_metrics_mean_sd", s="subject_id", f="entropy_mean entropy_std peak_mean peak_std", sql="""
    SELECT subject_id, avg(h) AS entropy_mean, CASE WHEN count(h) > 1 THEN stddev_pop(h) END AS entropy_std, avg(peak) AS peak_mean, CASE WHEN count(peak) > 1 THEN stddev_pop(peak) END AS peak_std FROM (
      SELECT subject_id, date, -sum(c / t * ln(c / t)) AS h, max(peak) AS peak FROM (SELECT *, sum(c) OVER (PARTITION BY subject_id, date) AS t, max(top) OVER (PARTITION BY subject_id, date) AS peak
        FROM (SELECT subject_id, date, code, count(*)::DOUBLE AS c, max(value) AS top FROM c_min GROUP BY 1, 2, 3)) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    d = t.day_arrays.select("subject_id", S.code_entropy(F.col("codes")).alias("entropy"), F.array_max("vals").alias("peak"))
    return d.groupBy("subject_id").agg(*[e for c in ("entropy", "peak") for e in (
        F.avg(c).alias(f"{c}_mean"), F.when(F.count(c) > 1, F.stddev_pop(c)).alias(f"{c}_std"))])


VAR = "mean median trimmed_mean mode min max mad kurtosis range sd cv iqr stv tbv rcv mr tbcr"


@query("variability_family", s="subject_id channel", f=VAR, sql=f"""
    WITH tr AS (SELECT subject_id, channel, avg(value) AS trimmed_mean FROM (SELECT *, row_number() OVER ({P} ORDER BY value) - 1 AS r FROM c_lf) WHERE r >= floor(nv * 0.1) AND r < nv - floor(nv * 0.1) {G}),
    mo AS (SELECT subject_id, channel, v AS mode FROM (SELECT *, row_number() OVER ({P} ORDER BY c DESC, v) AS rn FROM (SELECT subject_id, channel, round_even(value, 1) AS v, count(*) AS c FROM c_lf GROUP BY 1, 2, 3)) WHERE rn = 1),
    wi AS (SELECT subject_id, channel, avg(sd) AS stv, avg(sd / (abs(mu) + 1e-8)) AS rcv FROM (SELECT subject_id, channel, fpos, stddev_samp(value) OVER w AS sd, avg(value) OVER w AS mu FROM c_lf
      WINDOW w AS ({P} ORDER BY fpos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE fpos >= 6 {G}),
    bm AS (SELECT subject_id, channel, fpos // (nv // 4) AS b, avg(value) AS v FROM c_lf WHERE nv >= 4 AND fpos < (nv // 4) * 4 GROUP BY 1, 2, 3),
    tb AS (SELECT subject_id, channel, var_samp(v) AS tbv, avg(abs(v - pv)) AS tbcr FROM (SELECT *, lag(v) OVER ({P} ORDER BY b) AS pv FROM bm) {G}),
    mr AS (SELECT subject_id, channel, avg(abs(value - pv)) AS mr FROM (SELECT *, lag(value) OVER ({P} ORDER BY fpos) AS pv FROM c_lf) {G})
    SELECT k.subject_id, k.channel, {', '.join(f'CASE WHEN nv >= 3 THEN {e} END AS {c}' for c, e in (
        ('mean', 'm'), ('median', 'med'), ('trimmed_mean', 'trimmed_mean'), ('mode', 'mode'), ('min', 'lo'), ('max', 'hi'), ('mad', 'mad'),
        ('kurtosis', 'CASE WHEN nv > 3 AND sqrt(m2) > 1e-12 THEN m4 / (m2 * m2) - 3 END'), ('range', 'hi - lo'), ('sd', 'sqrt(m2 * nv / (nv - 1))'),
        ('cv', 'sqrt(m2 * nv / (nv - 1)) / (abs(m) + 1e-8)'), ('iqr', 'q75 - q25'), ('stv', 'stv'), ('tbv', 'tbv'), ('rcv', 'rcv'), ('mr', 'mr'), ('tbcr', 'tbcr')))}
    {on('c_mom', 'tr', 'mo', 'wi', 'tb', 'mr')}""")
def _(t):
    return U.variability_family(t.daily_arrays, K)


COMPACT = ("valid_day_ratio mean median trimmed_mean_10 robust_mode min max median_abs_deviation mean_abs_deviation kurtosis range std cv iqr short_term_variability "
           "moving_range_mean rolling7_sd_mean rolling7_cv_mean timebin_mean_std timebin_mean_range timebin_last_minus_first")


@query("compact_variability", s="subject_id channel", f=COMPACT, sql=f"""
    WITH gr AS (SELECT a.subject_id, a.channel, a.g AS pos, l.value FROM (SELECT subject_id, channel, max(day_index) AS d1, unnest(range(35)) AS g FROM c_long {G}) a
      LEFT JOIN c_long l ON l.subject_id = a.subject_id AND l.channel = a.channel AND l.day_index = a.d1 - 34 + a.g),
    gv AS (SELECT *, row_number() OVER ({P} ORDER BY value) - 1 AS r, count(*) OVER ({P}) AS n, avg(value) OVER ({P}) AS mu, median(value) OVER ({P}) AS me, min(value) OVER ({P}) AS lo, max(value) OVER ({P}) AS hi FROM gr WHERE value IS NOT NULL),
    st AS (SELECT subject_id, channel, max(n)::DOUBLE AS n, max(mu) AS mean, max(me) AS median, max(lo) AS lo, max(hi) AS hi, median(abs(value - me)) AS mad_med, avg(abs(value - mu)) AS mad_mean, stddev_pop(value) AS sd,
      avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 4)) AS m4, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
      avg(value) FILTER (WHERE r >= floor(n * 0.1) AND r < n - floor(n * 0.1)) AS tm FROM gv {G}),
    hb AS (SELECT *, greatest(least(CAST(ceil(sqrt(n)) AS INTEGER), 10), 3) AS nb FROM gv WHERE n >= 4 AND hi > lo),
    hm AS (SELECT subject_id, channel, lo + (b + 0.5) * (hi - lo) / nb AS rm FROM (SELECT *, row_number() OVER ({P} ORDER BY c DESC, b) AS rn FROM (
      SELECT subject_id, channel, lo, hi, nb, least(CAST(floor((value - lo) / (hi - lo) * nb) AS INTEGER), nb - 1) AS b, count(*) AS c FROM hb GROUP BY ALL)) WHERE rn = 1),
    df AS (SELECT subject_id, channel, median(d) AS stv, avg(d) AS mrm FROM (SELECT subject_id, channel, abs(value - lag(value) OVER ({P} ORDER BY pos)) AS d FROM gr) {G}),
    {roll('ro', 3, 7, 'gr')},
    bn AS (SELECT subject_id, channel, CASE WHEN pos < 9 THEN 0 WHEN pos < 18 THEN 1 WHEN pos < 27 THEN 2 ELSE 3 END AS b, avg(value) AS v FROM gr GROUP BY 1, 2, 3),
    tb AS (SELECT subject_id, channel, CASE WHEN count(v) >= 2 THEN stddev_pop(v) END AS ts, CASE WHEN count(v) >= 2 THEN max(v) - min(v) END AS tr, max(v) FILTER (WHERE b = 3) - max(v) FILTER (WHERE b = 0) AS tl FROM bn {G})
    SELECT k.subject_id, k.channel, coalesce(n, 0) / 35.0::DOUBLE AS valid_day_ratio, mean, median, CASE WHEN n >= 5 THEN tm ELSE mean END AS trimmed_mean_10, coalesce(rm, median) AS robust_mode, lo AS min, hi AS max,
      mad_med AS median_abs_deviation, mad_mean AS mean_abs_deviation, CASE WHEN n >= 4 AND m2 > 0 THEN ((n + 1) * (m4 / (m2 * m2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) END AS kurtosis, hi - lo AS range, sd AS std,
      sd / (abs(mean) + 1e-6) AS cv, iqr, stv AS short_term_variability, mrm AS moving_range_mean, rsd AS rolling7_sd_mean, rcv AS rolling7_cv_mean, ts AS timebin_mean_std, tr AS timebin_mean_range, tl AS timebin_last_minus_first
    {on('st', 'hm', 'df', 'ro', 'tb')}""")
def _(t):
    return U.compact_variability(t.daily_arrays, K)


L28 = f"SELECT *, row_number() OVER ({P} ORDER BY pos) - 1 AS p, count(*) OVER ({P}) AS k FROM c_lp WHERE pos >= n - 28"


@query("event_summary_eight", s="subject_id channel", f="median trimmed_mean_10 p10 p90 iqr mad theil_sen late_minus_early_half", sql=f"""
    WITH e AS ({L28}), v AS (SELECT *, row_number() OVER ({P} ORDER BY value) - 1 AS r, count(*) OVER ({P}) AS c, median(value) OVER ({P}) AS me FROM e WHERE value IS NOT NULL),
    st AS (SELECT subject_id, channel, max(c) AS c, median(value) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, median(abs(value - me)) AS mad,
      avg(value) FILTER (WHERE r >= floor(c * 0.1) AND r < c - floor(c * 0.1)) AS tm FROM v {G}),
    ts AS (SELECT a.subject_id, a.channel, median((b.value - a.value) / (b.p - a.p)) AS slope FROM v a JOIN v b ON a.subject_id = b.subject_id AND a.channel = b.channel AND b.p > a.p GROUP BY 1, 2),
    hf AS (SELECT subject_id, channel, median(value) FILTER (WHERE p >= ceil(k / 2.0)) - median(value) FILTER (WHERE p < ceil(k / 2.0)) AS d FROM e {G})
    SELECT k.subject_id, k.channel, median, tm AS trimmed_mean_10, p10, p90, iqr, mad, CASE WHEN c >= 3 THEN slope END AS theil_sen, d AS late_minus_early_half {on('st', 'ts', 'hf')}""")
def _(t):
    return U.event_summary(t.daily_arrays, K)


BIO = ("mean median std min max range p10 p25 p75 p90 iqr cv skew kurtosis first_last_delta rank_slope recent7_minus_all recent7_to_all_ratio autocorr1 entropy spectral_peak_ratio rolling7_variability")
QEDGE = ", ".join(f"quantile_cont(value, {k / 8})" for k in range(9))


@query("biological_statistics", s="subject_id channel", f=BIO, sql=f"""
    WITH fl AS (SELECT subject_id, channel, arg_max(value, fpos) - arg_min(value, fpos) AS fd, CASE WHEN count(*) >= 3 THEN regr_slope(value, pos / greatest(n - 1, 1)::DOUBLE) END AS rs FROM c_lf {G}),
    rc AS (SELECT subject_id, channel, avg(value) AS r7 FROM c_lp WHERE pos >= n - 7 {G}),
    ac AS (SELECT subject_id, channel, CASE WHEN count(*) >= 4 AND stddev_pop(value) > 1e-12 AND stddev_pop(pv) > 1e-12 THEN corr(value, pv) END AS a1 FROM (SELECT *, lag(value) OVER ({P} ORDER BY pos) AS pv FROM c_lp) WHERE value IS NOT NULL AND pv IS NOT NULL {G}),
    ed AS (SELECT subject_id, channel, list_sort(list_distinct([{QEDGE}])) AS edges FROM c_lf {G}),
    bn AS (SELECT f.subject_id, f.channel, least(len(list_filter(edges, lambda z: z <= value)), len(edges) - 1) AS bin, count(*)::DOUBLE AS c FROM c_lf f JOIN ed ON ed.subject_id = f.subject_id AND ed.channel = f.channel GROUP BY 1, 2, 3),
    en AS (SELECT subject_id, channel, -sum(c / t * ln(c / t)) / nullif(ln(count(*)), 0) AS h FROM (SELECT *, sum(c) OVER ({P}) AS t FROM bn) {G}),
    fi AS (SELECT subject_id, channel, pos, n, nv, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN nx WHEN nx IS NULL THEN pv ELSE pv + (nx - pv) * (pos - pp) / (np - pp) END AS value FROM (SELECT *,
      last_value(value IGNORE NULLS) OVER w1 AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS pp, first_value(value IGNORE NULLS) OVER w2 AS nx, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS np
      FROM c_lp WINDOW w1 AS ({P} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS ({P} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
    fx AS (SELECT subject_id, channel, pos, n, value - avg(value) OVER ({P}) AS c, stddev_pop(value) OVER ({P}) AS s, nv FROM fi),
    dx AS (SELECT subject_id, channel, hh, pow(sum(c * cos(2 * pi() * hh * pos / n)), 2) + pow(sum(c * sin(2 * pi() * hh * pos / n)), 2) AS pw FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS hh FROM fx WHERE nv >= 8 AND s > 1e-12) GROUP BY 1, 2, 3),
    sp AS (SELECT subject_id, channel, max(pw) / sum(pw) AS spr FROM dx {G}), {roll('ro', 3)}
    SELECT k.subject_id, k.channel, m AS mean, med AS median, sqrt(m2) AS std, lo AS min, hi AS max, hi - lo AS range, p10, q25 AS p25, q75 AS p75, p90, q75 - q25 AS iqr, CASE WHEN abs(m) > 1e-12 THEN sqrt(m2) / abs(m) END AS cv,
      CASE WHEN nv >= 3 THEN CASE WHEN sqrt(m2) > 1e-12 THEN m3 / pow(m2, 1.5) ELSE 0 END END AS skew, CASE WHEN nv >= 4 THEN CASE WHEN sqrt(m2) > 1e-12 THEN m4 / (m2 * m2) - 3 ELSE -3 END END AS kurtosis,
      fd AS first_last_delta, rs AS rank_slope, r7 - m AS recent7_minus_all, CASE WHEN abs(m) > 1e-12 THEN r7 / m END AS recent7_to_all_ratio, a1 AS autocorr1,
      CASE WHEN nv >= 5 AND hi - lo > 1e-12 AND len(edges) >= 3 THEN coalesce(h, 0) END AS entropy, spr AS spectral_peak_ratio, CASE WHEN n >= 3 THEN rsd END AS rolling7_variability
    {on('c_mom', 'fl', 'rc', 'ac', 'ed', 'en', 'sp', 'ro')}""")
def _(t):
    return U.biological_stats(t.daily_arrays, K)


@query("protocol_statistics", s="subject_id channel", i="length valid_days longest_missing_run", f="missing_fraction", sql=f"""
    WITH r AS (SELECT subject_id, channel, max(c) AS l FROM (SELECT subject_id, channel, isl, count(*) AS c FROM (SELECT *, pos - row_number() OVER ({P} ORDER BY pos) AS isl FROM c_lp WHERE value IS NULL) GROUP BY 1, 2, 3) {G}),
    a AS (SELECT subject_id, channel, count(*) AS n, count(value) AS v FROM c_lp {G})
    SELECT k.subject_id, k.channel, n AS length, v AS valid_days, coalesce(l, 0) AS longest_missing_run, 1 - v / n::DOUBLE AS missing_fraction {on('a', 'r')}""")
def _(t):
    return U.protocol_stats(t.daily_arrays, K)


@query("multi_lookback_stats", s="subject_id channel", i="width", f="valid_day_ratio mean std median iqr p10 p90 slope", sql=f"""
    SELECT subject_id, channel, width, count(value) / width::DOUBLE AS valid_day_ratio, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
      quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, CASE WHEN count(value) >= 3 THEN regr_slope(value, (width - 1 - (last_day - day_index)) / (width - 1)::DOUBLE) END AS slope
    FROM c_lp, (VALUES (7), (14), (28)) AS w(width) WHERE last_day - day_index < width GROUP BY 1, 2, 3""")
def _(t):
    anchors = t.daily.groupBy("subject_id").agg(F.max("date").alias("anchor"))
    d = J.lookbacks(t.long, anchors, "subject_id", "date", (7, 14, 28))
    return U.lookback_stats(d, K, "value", "width", F.datediff("anchor", "date"))


PAY = "missing_rate mean sd cv median p10 p90 iqr min max trend_per_week late_minus_early weekend_minus_weekday"


@query("payload_linear_stats", s="subject_id channel", i="n_valid", f=PAY, digits=3, sql=f"""
    WITH tr AS (SELECT subject_id, channel, CASE WHEN count(*) >= 3 THEN regr_slope(value, day_index) * 7 END AS trend FROM c_lf {G}), {THIRDS}, {weekend(2)}, n0 AS (SELECT subject_id, channel, count(value) AS nvalid, count(*) AS nall FROM c_long {G})
    SELECT k.subject_id, k.channel, nvalid AS n_valid, 1 - nvalid / nall::DOUBLE AS missing_rate, m AS mean, CASE WHEN nv > 1 THEN sqrt(m2 * nv / (nv - 1)) WHEN nv = 1 THEN 0 END AS sd,
      CASE WHEN abs(m) > 1e-9 THEN CASE WHEN nv > 1 THEN sqrt(m2 * nv / (nv - 1)) / abs(m) ELSE 0 END END AS cv, med AS median, p10, p90, q75 - q25 AS iqr, lo AS min, hi AS max, trend AS trend_per_week, late_minus_early,
      weekend_delta AS weekend_minus_weekday {on('n0', 'c_mom', 'tr', 'th', 'we')}""")
def _(t):
    return U.payload_stats(t.daily_arrays, K, digits=9)


@query("weekly_summary", s="subject_id channel", i="week days", f="mean", sql="""
    SELECT subject_id, channel, day_index // 7 AS week, count(*) AS days, avg(value) AS mean FROM c_long GROUP BY 1, 2, 3""")
def _(t):
    return t.long.groupBy("subject_id", "channel", F.floor(F.col("day_index") / 7).alias("week")).agg(F.count("*").alias("days"), F.avg("value").alias("mean"))


HR = "(hour(first_ts) + minute(first_ts) / 60.0::DOUBLE + second(first_ts) / 3600.0::DOUBLE)"
CIRC = f"""SELECT subject_id, n, (atan2(s, c) + 2 * pi()) % (2 * pi()) * 24 / (2 * pi()) AS mean_hour, CASE WHEN n >= 2 AND sqrt(s * s + c * c) > 1e-12 THEN sqrt(-2 * ln(least(sqrt(s * s + c * c), 1))) * 24 / (2 * pi()) END AS sd_hours
    FROM (SELECT subject_id, count(*) AS n, avg(sin(2 * pi() * {HR} / 24)) AS s, avg(cos(2 * pi() * {HR} / 24)) AS c FROM c_day GROUP BY 1)"""


@query("circular_mean_sd", s="subject_id", i="n_valid", f="mean_hour sd_hours", sql=f"SELECT subject_id, n AS n_valid, mean_hour, sd_hours FROM ({CIRC})")
def _(t):
    return U.circular_stats(t.daily.withColumn("hh", C.clock_hour(F.col("first_ts"))), ["subject_id"], "hh")


@query("circular_deviation", s="subject_id date", f="deviation", sql=f"""
    SELECT d.subject_id, d.date, ((({HR} - mean_hour + 12) % 24) + 24) % 24 - 12 AS deviation FROM c_day d JOIN ({CIRC}) c ON c.subject_id = d.subject_id""")
def _(t):
    d = t.daily.withColumn("hh", C.clock_hour(F.col("first_ts")))
    m = U.circular_stats(d, ["subject_id"], "hh").select("subject_id", "mean_hour")
    return d.join(m, "subject_id").select("subject_id", "date", C.circular_gap(F.col("hh"), F.col("mean_hour")).alias("deviation"))


@query("interdaily_stability_intradaily_variability", s="subject_id", i="n_points", f="is_value iv_value", sql="""
    WITH c AS (SELECT subject_id, date, minute // 60 AS hour, avg(value) AS value FROM c_min WHERE value IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT *, avg(value) OVER (PARTITION BY subject_id) AS gm, dense_rank() OVER (PARTITION BY subject_id ORDER BY date) * 24 + hour AS cell FROM c),
    e AS (SELECT *, CASE WHEN cell - lag(cell) OVER (PARTITION BY subject_id ORDER BY cell) = 1 THEN value - lag(value) OVER (PARTITION BY subject_id ORDER BY cell) END AS step FROM d),
    t AS (SELECT subject_id, count(*) AS n, sum(pow(value - gm, 2)) AS tot, coalesce(sum(step * step), 0) AS suc FROM e GROUP BY 1),
    b AS (SELECT subject_id, sum(pow(hm - gm, 2)) AS b FROM (SELECT subject_id, hour, avg(value) AS hm, max(gm) AS gm FROM e GROUP BY 1, 2) GROUP BY 1)
    SELECT t.subject_id, n AS n_points, n * b / (24 * tot) AS is_value, n * suc / ((n - 1) * tot) AS iv_value FROM t JOIN b ON b.subject_id = t.subject_id""")
def _(t):
    cells = t.minutes.where("value is not null").groupBy("subject_id", "date", F.floor(F.col("minute") / 60).alias("hour")).agg(F.avg("value").alias("value"))
    return U.stability_variability(cells, "subject_id")


@query("sleep_regularity_index", s="subject_id", i="pair_index", f="sri", sql="""
    WITH b AS (SELECT subject_id, CAST(floor(epoch(start_ts)) AS BIGINT) AS s, CAST(floor(epoch(end_ts)) AS BIGINT) AS e FROM c_ep),
    ep AS (SELECT DISTINCT subject_id, unnest(range(s // 300, e // 300)) AS ep FROM b WHERE e > s),
    sp AS (SELECT subject_id, min(s) // 86400 AS d0, CAST(ceil(max(e) / 86400.0) AS BIGINT) AS d1 FROM b WHERE e > s GROUP BY 1),
    cell AS (SELECT sp.subject_id, d0, d1, d, q, ep.ep IS NOT NULL AS z FROM sp, (SELECT unnest(range(0, 40)) AS d), (SELECT unnest(range(0, 288)) AS q) LEFT JOIN ep ON ep.subject_id = sp.subject_id AND ep.ep = (d0 + d) * 288 + q WHERE d < d1 - d0)
    SELECT a.subject_id, a.d AS pair_index, -100 + 200 * avg((a.z = b.z)::INT) AS sri FROM cell a JOIN cell b ON a.subject_id = b.subject_id AND a.q = b.q AND b.d = a.d + 1 GROUP BY 1, 2""")
def _(t):
    return U.sleep_regularity(t.episodes, "subject_id", "start_ts", "end_ts")


ARCH = "signup_mean signup_std purchase_mean purchase_std hr_span_mean hr_span_std"


@query("sleep_architecture", s="subject_id", f=ARCH, sql=f"""
    SELECT subject_id, {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std' for c in ('signup', 'purchase', 'hr_span'))} FROM (
      SELECT subject_id, date, count(*) FILTER (WHERE event_type = 'signup') / nullif(count(*), 0)::DOUBLE AS signup, count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*), 0)::DOUBLE AS purchase, avg(value) - min(value) AS hr_span
      FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, event_type, value FROM events) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    night = t.events.groupBy("subject_id", "date").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("event_type") == "signup", 1)).alias("a"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("b"), (F.avg("value") - F.min("value")).alias("hr_span"))
    d = night.select("subject_id", F.try_divide("a", "total").alias("signup"), F.try_divide("b", "total").alias("purchase"), "hr_span")
    return d.groupBy("subject_id").agg(*[e for c in ("signup", "purchase", "hr_span") for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


@query("activity_composition", s="subject_id", f="active moderate_high high", sql="""
    SELECT subject_id, avg((low + med + hi) / nullif(rest + ina + low + med + hi, 0)) AS active, avg((med + hi) / nullif(low + med + hi, 0)) AS moderate_high, avg(hi / nullif(low + med + hi, 0)) AS high FROM (
      SELECT subject_id, date, count(*) FILTER (WHERE code = 1)::DOUBLE AS rest, count(*) FILTER (WHERE code = 2)::DOUBLE AS ina, count(*) FILTER (WHERE code = 3)::DOUBLE AS low, count(*) FILTER (WHERE code = 4)::DOUBLE AS med,
        count(*) FILTER (WHERE code = 5)::DOUBLE AS hi FROM c_min GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    n = ("rest", "inactive", "low", "medium", "high")
    d = t.minutes.groupBy("subject_id", "date").agg(*[F.count(F.when(F.col("code") == k + 1, 1)).alias(c) for k, c in enumerate(n)])
    act = F.col("low") + F.col("medium") + F.col("high")
    return d.groupBy("subject_id").agg(
        F.avg(F.try_divide(act, F.col("rest") + F.col("inactive") + act)).alias("active"),
        F.avg(F.try_divide(F.col("medium") + F.col("high"), act)).alias("moderate_high"), F.avg(F.try_divide(F.col("high"), act)).alias("high"))


@query("daily_sleep_count", s="subject_id date", i="n", sql="SELECT subject_id, date, count(*) AS n FROM c_ep GROUP BY 1, 2")
def _(t):
    return t.episodes.groupBy("subject_id", "date").agg(F.count("*").alias("n"))


@query("coverage_table", s="subject_id", i="rows days span duplicates first_offset max_gap", f="coverage mean_gap", sql="""
    WITH p AS (SELECT subject_id, date, count(*) AS r FROM c_ep GROUP BY 1, 2), g AS (SELECT *, date - lag(date) OVER (PARTITION BY subject_id ORDER BY date) AS gap FROM p)
    SELECT subject_id, sum(r) AS rows, count(*) AS days, max(date) - min(date) + 1 AS span, count(*) / (max(date) - min(date) + 1)::DOUBLE AS coverage, sum(r) - count(*) AS duplicates,
      min(date) - (SELECT min(date) FROM p) AS first_offset, max(gap) AS max_gap, avg(gap) AS mean_gap FROM g GROUP BY 1""")
def _(t):
    return U.coverage(t.episodes, "subject_id", "date")


@query("cross_modality_coverage", s="subject_id", i="both left_only right_only", f="matched_ratio", sql="""
    SELECT subject_id, b AS both, l AS left_only, r AS right_only, b / (b + l + r)::DOUBLE AS matched_ratio FROM (SELECT coalesce(a.subject_id, s.subject_id) AS subject_id, count(*) FILTER (WHERE a.date IS NOT NULL AND s.date IS NOT NULL) AS b,
      count(*) FILTER (WHERE s.date IS NULL) AS l, count(*) FILTER (WHERE a.date IS NULL) AS r FROM c_act a FULL JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date GROUP BY 1)""")
def _(t):
    p = J.presence(t.activity, t.sleep, ["subject_id", "date"]).groupBy("subject_id").agg(
        *[F.count(F.when(F.col("side") == k, 1)).alias(k) for k in ("both", "left_only", "right_only")])
    return p.withColumn("matched_ratio", F.try_divide("both", F.col("both") + F.col("left_only") + F.col("right_only")))


@query("subject_missing_fraction", s="subject_id channel", f="missing median day_iqr", sql=f"""
    SELECT subject_id, channel, 1 - count(value) / count(*)::DOUBLE AS missing, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS day_iqr FROM c_long {G}""")
def _(t):
    p = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return t.long.groupBy(*K).agg((1 - F.count("value") / F.count("*")).alias("missing"), p.alias("p")).select(
        *K, "missing", F.col("p")[1].alias("median"), (F.col("p")[2] - F.col("p")[0]).alias("day_iqr"))


@query("detrended_sd", s="subject_id channel", i="n", f="sd", sql=f"""
    WITH r AS (SELECT *, value - (regr_slope(value, day_index) OVER ({P}) * day_index + regr_intercept(value, day_index) OVER ({P})) AS res FROM c_lf)
    SELECT k.subject_id, k.channel, coalesce(z.n, 0) AS n, sd FROM c_lk k LEFT JOIN (SELECT subject_id, channel, count(*) AS n, CASE WHEN count(*) >= 8 THEN stddev_pop(res) END AS sd FROM r {G}) z ON z.subject_id = k.subject_id AND z.channel = k.channel""")
def _(t):
    return U.detrended_sd(t.long, K, "day_index", "value")


@query("lag1_consecutive_corr", s="subject_id channel", i="n_pairs", f="r", sql="""
    SELECT b.subject_id, b.channel, count(*) AS n_pairs, CASE WHEN count(*) >= 10 AND stddev_pop(a.value) > 1e-12 AND stddev_pop(b.value) > 1e-12 THEN corr(a.value, b.value) END AS r FROM c_lf a JOIN c_lf b ON a.subject_id = b.subject_id AND a.channel = b.channel AND b.day_index = a.day_index + 1 GROUP BY 1, 2""")
def _(t):
    d = J.adjacent_days(t.long.withColumn("sc", F.concat_ws("|", "subject_id", "channel")), "sc", "date", "value").where("value is not null and prev is not null")
    ok = (F.count("*") >= 10) & (F.stddev_pop("prev") > 1e-12) & (F.stddev_pop("value") > 1e-12)
    return d.groupBy(*K).agg(F.count("*").alias("n_pairs"), F.when(ok, correlation("prev", "value")).alias("r"))


@query("paired_day_correlation", s="subject_id", i="n", f="r", sql="""
    SELECT a.subject_id, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(act_max) > 0 AND stddev_pop(slp_max) > 0 THEN corr(act_max, slp_max) END AS r FROM c_act a JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date GROUP BY 1""")
def _(t):
    ok = (F.count("*") >= 5) & (F.stddev_pop("act_max") > 0) & (F.stddev_pop("slp_max") > 0)
    return J.join_modalities(t.activity, t.sleep).groupBy("subject_id").agg(F.count("*").alias("n"), F.when(ok, correlation("act_max", "slp_max")).alias("r"))


@query("crosstab_counts", i="fold c0 c1 c2", sql="""
    SELECT fold, count(*) FILTER (WHERE y3 = 0) AS c0, count(*) FILTER (WHERE y3 = 1) AS c1, count(*) FILTER (WHERE y3 = 2) AS c2 FROM c_cust GROUP BY 1""")
def _(t):
    p = t.customers.groupBy("fold").pivot("y3", [0, 1, 2]).count()
    return p.select("fold", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"c{k}") for k in range(3)])


def item_sql(i):
    x = f"{h(repr(i), 'c_custkey')} % 3"
    return f"CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE {x} END AS {i}"


INST = "orient_time orient_place registration attention recall language total recall_deficit total_deficit below_24 below_27 orientation_error"
NONE_SQL = "greatest(" + ", ".join(U.ITEMS) + ") > 0"


def dsum(items):
    return "CASE WHEN " + NONE_SQL + " THEN " + " + ".join(f"CASE WHEN {i} = 2 THEN 1 ELSE 0 END" for i in items) + " END"


@query("instrument_domain_scores", s="subject_id", i=INST, f="pass_share", sql=f"""
    WITH q AS (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, {', '.join(item_sql(i) for i in U.ITEMS)} FROM customer),
    d AS (SELECT subject_id, {', '.join(f'{dsum(v)} AS {k}' for k, v in U.DOMAINS.items())}, {dsum(U.ITEMS)} AS total FROM q)
    SELECT *, 3 - recall AS recall_deficit, 30 - total AS total_deficit, total / 30.0::DOUBLE AS pass_share, (total < 24)::INT AS below_24, (total < 27)::INT AS below_27, (orient_time + orient_place < 10)::INT AS orientation_error FROM d""")
def _(t):
    k = F.col("c_custkey")
    q = t.table("customer").select(k.cast("string").alias("subject_id"), *[
        F.when(k % 50 == 7, 0).otherwise(hash_int(i, k) % 3).cast("int").alias(i) for i in U.ITEMS])
    return U.instrument_scores(q, ["subject_id"])


@query("domain_interactions", s="subject_id date", f="deep_total high_inactive sd_mean product", sql="""
    SELECT subject_id, date, click_v / nullif(abs(v_max), 0) AS deep_total, view_v / nullif(abs(error_v), 0) AS high_inactive, (v_max - v_mean) / nullif(abs(v_mean), 0) AS sd_mean, click_v * view_v AS product FROM c_day""")
def _(t):
    from diurna.functions.numbers import ratio

    c = F.col
    return t.daily.select("subject_id", "date", ratio(c("click_v"), F.abs("v_max"), 0).alias("deep_total"), ratio(c("view_v"), F.abs("error_v"), 0).alias("high_inactive"),
                          ratio(c("v_max") - c("v_mean"), F.abs("v_mean"), 0).alias("sd_mean"), (c("click_v") * c("view_v")).alias("product"))


@query("cross_block_interactions", s="subject_id", f="recall_x_v_max_cv recall_x_click_v_cv recall_x_purchase_v_cv", sql=f"""
    SELECT subject_id, {', '.join(f"max((1 - {h(repr('r'), 'subject_id')} % 7 / 6.0::DOUBLE) * cv) FILTER (WHERE channel = '{c}') AS recall_x_{c}_cv" for c in ('v_max', 'click_v', 'purchase_v'))}
    FROM (SELECT subject_id, channel, stddev_pop(value) / abs(avg(value)) AS cv FROM c_long {G}) GROUP BY 1""")
def _(t):
    lite = U.lite_stats(t.long, K).groupBy("subject_id").pivot("channel", ["v_max", "click_v", "purchase_v"]).agg(F.max("cv"))
    deficit = 1 - hash_int("r", F.col("subject_id")) % 7 / F.lit(6.0)
    return lite.select("subject_id", *[(deficit * F.col(c)).alias(f"recall_x_{c}_cv") for c in ("v_max", "click_v", "purchase_v")])


RHO = "CASE WHEN count(*) >= 10 THEN corr(ra, rb) END"


@query("split_half_reliability", s="channel", i="n", f="rho spearman_brown", sql=f"""
    WITH f AS (SELECT subject_id, channel, day_index % 2 AS half, stddev_pop(value) AS v FROM c_long GROUP BY 1, 2, 3),
    p AS (SELECT a.subject_id, a.channel, a.v AS a, b.v AS b FROM f a JOIN f b ON a.subject_id = b.subject_id AND a.channel = b.channel WHERE a.half = 0 AND b.half = 1 AND a.v IS NOT NULL AND b.v IS NOT NULL),
    r AS (SELECT channel, rank() OVER (PARTITION BY channel ORDER BY a) + (count(*) OVER (PARTITION BY channel, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY channel ORDER BY b) + (count(*) OVER (PARTITION BY channel, b) - 1) / 2.0 AS rb FROM p)
    SELECT channel, count(*) AS n, {RHO} AS rho, 2 * {RHO} / (1 + {RHO}) AS spearman_brown FROM r GROUP BY 1""")
def _(t):
    f = t.long.groupBy("subject_id", "channel", F.pmod("day_index", F.lit(2)).alias("half")).agg(F.stddev_pop("value").alias("v"))
    wide = f.groupBy("subject_id", "channel").pivot("half", [0, 1]).agg(F.max("v"))
    r = spearman(wide.withColumnsRenamed({"0": "a", "1": "b"}), ["channel"], "a", "b", 10)
    return r.withColumn("spearman_brown", F.when(F.col("rho") > -1, 2 * F.col("rho") / (1 + F.col("rho"))))


@query("confound_audit", s="feature covariate", i="n flagged", f="rho", sql="""
    WITH f AS (SELECT subject_id, max(v_max) AS peak, max(click_v) AS click, min(v_max) AS low, count(*) AS days, sum(n) AS events FROM c_day GROUP BY 1),
    x AS (SELECT subject_id, unnest(['peak', 'click', 'low']) AS feature, unnest([peak, click, low]) AS fv FROM f), z AS (SELECT subject_id, unnest(['days', 'events']) AS covariate, unnest([days, CAST(events AS BIGINT)]) AS cv FROM f),
    j AS (SELECT feature, covariate, fv, cv FROM x JOIN z ON x.subject_id = z.subject_id WHERE fv IS NOT NULL),
    r AS (SELECT feature, covariate, rank() OVER (PARTITION BY feature, covariate ORDER BY fv) + (count(*) OVER (PARTITION BY feature, covariate, fv) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY feature, covariate ORDER BY cv) + (count(*) OVER (PARTITION BY feature, covariate, cv) - 1) / 2.0 AS rb FROM j)
    SELECT feature, covariate, count(*) AS n, corr(ra, rb) AS rho, abs(corr(ra, rb)) > 0.3 AS flagged FROM r GROUP BY 1, 2""")
def _(t):
    g = t.daily.groupBy("subject_id").agg(F.max("v_max").alias("peak"), F.max("click_v").alias("click"), F.min("v_max").alias("low"),
                                          F.count("*").cast("double").alias("days"), F.sum("n").cast("double").alias("events"))
    long = stack_columns(stack_columns(g, ["days", "events"], ["peak", "click", "low"], "feature", "fv"), ["feature", "fv"], ["days", "events"], "covariate", "cv")
    return spearman(long, ["feature", "covariate"], "fv", "cv").withColumn("flagged", F.abs("rho") > 0.3)
