"""Array features of intraday series, restated as grouping and window SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.functions import series as S
from diurna.operators import intraday as I
from diurna.plans.registry import query

K = ["subject_id", "wk"]
DK = ["subject_id", "date"]
G = "GROUP BY subject_id, wk"
ALLK = "(SELECT DISTINCT subject_id, wk FROM c_rec)"


def rec(t, cols: dict, *more):
    return t.recordings.select(*K, *more, *[e.alias(k) for k, e in cols.items()])


def islands(flag: str, src: str = "c_rec", keys: str = "subject_id, wk") -> str:
    """Run table (keys, f, start, length) of a flag expression."""
    return (f"SELECT {keys}, f, min(pos) AS start, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY {keys}, f ORDER BY pos) AS isl "
            f"FROM (SELECT {keys}, pos, {flag} AS f FROM {src})) GROUP BY {keys}, f, isl")


@query("parse_slash_series", s="subject_id date variant", i="pos", f="value", sql="""
    WITH tok AS (SELECT subject_id, date, pos, x FROM
        (SELECT subject_id, date, unnest(string_split(rtrim(txt, '/'), '/')) AS x, generate_subscripts(string_split(rtrim(txt, '/'), '/'), 1) - 1 AS pos FROM c_raw)),
    val AS (SELECT subject_id, date, pos, TRY_CAST(x AS DOUBLE) AS value FROM tok)
    SELECT subject_id, date, 'keep' AS variant, pos, value FROM val
    UNION ALL SELECT subject_id, date, 'drop', row_number() OVER (PARTITION BY subject_id, date ORDER BY pos) - 1, value FROM val WHERE value IS NOT NULL""")
def _(t):
    d = t.raw_days
    return d.select("subject_id", "date", F.lit("keep").alias("variant"), F.posexplode(I.parse_series(F.col("txt"))).alias("pos", "value")).unionAll(
        d.select("subject_id", "date", F.lit("drop"), F.posexplode(I.parse_series(F.col("txt"), False))))


@query("series_length_gate", s="subject_id date", i="n accepted", sql="""
    SELECT subject_id, date, CASE WHEN count(*) = 3 AND max(code) <= 4 THEN 3 END AS n, count(*) = 3 AND max(code) <= 4 AS accepted FROM c_min GROUP BY 1, 2""")
def _(t):
    g = I.length_gate(I.parse_series(F.col("codes_txt")), 3, 0, 4)
    return t.raw_days.select("subject_id", "date", F.when(g.isNotNull(), F.size(g)).alias("n"), g.isNotNull().alias("accepted"))


@query("pad_or_truncate", s="subject_id wk", i="pos", f="value", sql=f"""
    SELECT k.subject_id, k.wk, k.pos, coalesce(f.value, -1) AS value FROM (SELECT subject_id, wk, unnest(range(12)) AS pos FROM {ALLK}) k
    LEFT JOIN c_fin f ON f.subject_id = k.subject_id AND f.wk = k.wk AND f.pos = k.pos""")
def _(t):
    return t.recordings.select(*K, F.posexplode(S.pad_or_truncate(S.known(F.col("vals")), 12)).alias("pos", "value"))


@query("downsample_mean", s="subject_id wk", i="pos", f="value", sql="""
    SELECT subject_id, wk, pos // 5 AS pos, avg(value) AS value FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, wk, pos // 5) AS k FROM c_rec) WHERE k = 5 GROUP BY subject_id, wk, pos // 5""")
def _(t):
    return t.recordings.select(*K, F.posexplode(S.block_means(F.col("vals"), 5)).alias("pos", "value"))


@query("downsample_mode", s="subject_id wk", i="pos code", sql="""
    SELECT subject_id, wk, b AS pos, code FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, wk, b ORDER BY c DESC, p0) AS rn FROM (
      SELECT subject_id, wk, b, code, count(*) AS c, min(pos) AS p0 FROM (SELECT *, pos // 5 AS b, count(*) OVER (PARTITION BY subject_id, wk, pos // 5) AS k FROM c_rec) WHERE k = 5
      GROUP BY subject_id, wk, b, code)) WHERE rn = 1""")
def _(t):
    return t.recordings.select(*K, F.posexplode(S.block_modes(F.col("codes"), 5)).alias("pos", "code"))


@query("upsample_repeat", s="subject_id wk", i="pos code", sql="""
    SELECT subject_id, wk, pos * 5 + r AS pos, code FROM c_rec, (SELECT unnest(range(5)) AS r)""")
def _(t):
    up = F.flatten(F.transform("codes", lambda x: F.array_repeat(x, 5)))
    return t.recordings.select(*K, F.posexplode(up).alias("pos", "code"))


@query("hourly_profile", s="subject_id date", i="hour", f="value", sql="""
    SELECT d.subject_id, d.date, d.hour, m.value FROM (SELECT subject_id, date, unnest(range(24)) AS hour FROM (SELECT DISTINCT subject_id, date FROM c_min)) d
    LEFT JOIN (SELECT subject_id, date, minute // 60 AS hour, avg(value) AS value FROM c_min GROUP BY ALL) m ON m.subject_id = d.subject_id AND m.date = d.date AND m.hour = d.hour""")
def _(t):
    dense = t.day_arrays.withColumn("grid", S.densify(F.col("mins"), F.col("vals"), 1440))
    return dense.select("subject_id", "date", F.posexplode(S.block_means(F.col("grid"), 60)).alias("hour", "value"))


@query("class_fractions", s="subject_id wk", f="code_1 code_2 code_3 code_4 unknown active not_worn", sql=f"""
    SELECT subject_id, wk, {', '.join(f'avg(CASE WHEN code = {k} THEN 1.0::DOUBLE ELSE 0 END) AS code_{k}' for k in (1, 2, 3, 4))},
      avg(CASE WHEN code > 4 THEN 1.0::DOUBLE ELSE 0 END) AS unknown, avg(CASE WHEN code >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS active, avg(CASE WHEN code = 5 THEN 1.0::DOUBLE ELSE 0 END) AS not_worn FROM c_rec {G}""")
def _(t):
    return rec(t, I.class_fractions(F.col("codes"), (1, 2, 3, 4), 3, 5))


@query("class_counts", s="subject_id wk", i="n1 n2 n3 n4 n5", sql=f"""
    SELECT subject_id, wk, {', '.join(f'count(*) FILTER (WHERE code = {k}) AS n{k}' for k in range(1, 6))} FROM c_rec {G}""")
def _(t):
    return rec(t, {f"n{k}": S.count_if(F.col("codes"), S.is_code(k)) for k in range(1, 6)})


@query("transition_rate", s="subject_id wk", f="rate per_hour", sql=f"""
    SELECT subject_id, wk, avg(CASE WHEN prev IS NOT NULL AND c IS NOT NULL THEN CASE WHEN c <> prev THEN 1.0::DOUBLE ELSE 0 END END) AS rate,
      count(*) FILTER (WHERE c <> prev) / (count(c) / 12.0::DOUBLE) AS per_hour
    FROM (SELECT *, lag(c) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS prev FROM (SELECT *, CASE WHEN value IS NOT NULL OR minute % 2 = 0 THEN code END AS c FROM c_rec)) {G}""")
def _(t):
    c = F.zip_with("codes", F.zip_with("vals", "mins", lambda v, m: v.isNotNull() | (m % 2 == 0)), lambda c, ok: F.when(ok, c))
    d = t.recordings.withColumn("c", c)
    changes = S.count_if(S.adjacent(F.col("c"), lambda x, y: x != y), lambda z: z)
    return d.select(*K, S.transition_rate(F.col("c")).alias("rate"), F.try_divide(changes, F.size(S.known(F.col("c"))) / F.lit(12.0)).alias("per_hour"))


@query("transition_pair_rate", s="subject_id wk", f="light_awake deep_light", sql=f"""
    SELECT subject_id, wk, count(*) FILTER (WHERE prev = 2 AND code = 4) / greatest(1.0::DOUBLE, count(*) / 12.0::DOUBLE) AS light_awake,
      count(*) FILTER (WHERE prev = 1 AND code = 2) / greatest(1.0::DOUBLE, count(*) / 12.0::DOUBLE) AS deep_light
    FROM (SELECT *, lag(code) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS prev FROM c_rec) {G}""")
def _(t):
    hours = F.greatest(F.lit(1.0), F.size("codes") / F.lit(12.0))
    return rec(t, {"light_awake": S.pair_count(F.col("codes"), 2, 4) / hours, "deep_light": S.pair_count(F.col("codes"), 1, 2) / hours})


@query("run_lengths", s="subject_id wk", i="start length code", sql=f"SELECT subject_id, wk, start, length, f AS code FROM ({islands('code')})")
def _(t):
    return t.recordings.select(*K, F.inline(S.runs(F.col("codes")))).withColumnRenamed("value", "code")


BOUT = f"SELECT * FROM ({islands('CASE WHEN value >= 40 THEN 1 ELSE 0 END', 'c_fin')}) WHERE f = 1"


@query("bout_stats", s="subject_id wk", i="bout_max bout_n", f="bout_mean", sql=f"""
    SELECT k.subject_id, k.wk, max(length) AS bout_max, count(length) AS bout_n, avg(length) AS bout_mean FROM {ALLK} k LEFT JOIN ({BOUT}) r ON r.subject_id = k.subject_id AND r.wk = k.wk GROUP BY ALL""")
def _(t):
    return rec(t, I.bout_stats(F.col("vals"), lambda x: x >= 40))


@query("longest_run_ratio", s="subject_id wk", f="ratio", sql=f"""
    SELECT k.subject_id, k.wk, coalesce(max(r.length), 0) / max(k.n)::DOUBLE AS ratio FROM (SELECT subject_id, wk, count(*) AS n FROM c_rec {G}) k
    LEFT JOIN (SELECT * FROM ({islands('code >= 4')}) WHERE f) r ON r.subject_id = k.subject_id AND r.wk = k.wk GROUP BY k.subject_id, k.wk""")
def _(t):
    return rec(t, {"ratio": S.longest_run(F.col("codes"), lambda x: x >= 4) / F.greatest(F.size("codes"), F.lit(1))})


def ent(src: str, keys: str = "subject_id, wk") -> str:
    return f"SELECT {keys}, -sum(c / t * ln(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS t FROM ({src})) GROUP BY {keys}"


HIST = """SELECT subject_id, wk, least(floor((value - lo) / (hi - lo) * 16), 15) AS b, count(*)::DOUBLE AS c FROM
    (SELECT *, min(value) OVER (PARTITION BY subject_id, wk) AS lo, max(value) OVER (PARTITION BY subject_id, wk) AS hi FROM c_fin) WHERE hi > lo GROUP BY ALL"""


@query("histogram_entropy", s="subject_id wk", f="h", sql=f"SELECT k.subject_id, k.wk, h FROM {ALLK} k LEFT JOIN ({ent(HIST)}) e ON e.subject_id = k.subject_id AND e.wk = k.wk")
def _(t):
    return rec(t, {"h": S.histogram_entropy(F.col("vals"), 16)})


@query("categorical_entropy", s="subject_id wk", f="h", sql=ent("SELECT subject_id, wk, code, count(*)::DOUBLE AS c FROM c_rec GROUP BY ALL"))
def _(t):
    return rec(t, {"h": S.code_entropy(F.col("codes"))})


QE = ", ".join(f"quantile_cont(value, {k / 8})" for k in range(9))


@query("quantile_entropy", s="subject_id wk", f="h", sql=f"""
    WITH e AS (SELECT subject_id, wk, list_sort(list_distinct([{QE}])) AS edges, count(*) AS n, max(value) - min(value) AS spread FROM c_fin {G}),
    b AS (SELECT f.subject_id, f.wk, least(len(list_filter(e.edges, lambda z: z <= f.value)), len(e.edges) - 1) AS bin, count(*)::DOUBLE AS c FROM c_fin f JOIN e ON e.subject_id = f.subject_id AND e.wk = f.wk GROUP BY ALL),
    h AS (SELECT subject_id, wk, -sum(c / t * ln(c / t)) AS h, count(*) AS nb FROM (SELECT *, sum(c) OVER (PARTITION BY subject_id, wk) AS t FROM b) {G})
    SELECT k.subject_id, k.wk, CASE WHEN e.n >= 5 AND spread > 1e-12 AND len(edges) >= 3 THEN CASE WHEN nb > 1 THEN h / ln(nb) ELSE 0 END END AS h
    FROM {ALLK} k LEFT JOIN e ON e.subject_id = k.subject_id AND e.wk = k.wk LEFT JOIN h ON h.subject_id = k.subject_id AND h.wk = k.wk""")
def _(t):
    return rec(t, {"h": S.quantile_entropy(F.col("vals"))})


@query("transition_entropy", s="subject_id wk", f="bits", sql=f"""
    WITH p AS (SELECT subject_id, wk, prev, code, count(*)::DOUBLE AS c FROM (SELECT *, lag(code) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS prev FROM c_rec) WHERE prev IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, sum(c) OVER (PARTITION BY subject_id, wk, prev) AS rowsum, sum(c) OVER (PARTITION BY subject_id, wk) AS total FROM p)
    SELECT k.subject_id, k.wk, -sum(c / total * log2(c / rowsum)) AS bits FROM {ALLK} k LEFT JOIN r ON r.subject_id = k.subject_id AND r.wk = k.wk GROUP BY k.subject_id, k.wk""")
def _(t):
    return rec(t, {"bits": S.transition_entropy(F.col("codes"), (1, 2, 3, 4, 5))})


QS = ", ".join(f"quantile_cont(value, {q}) AS {n}" for q, n in ((0.1, "q10"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.9, "q90")))


@query("series_numeric_stats", s="subject_id wk", i="valid_n", f="valid_ratio mean std var min max q10 q25 median q75 q90 iqr", sql=f"""
    SELECT subject_id, wk, count(value) AS valid_n, count(value) / 288.0::DOUBLE AS valid_ratio, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS var, min(value) AS min, max(value) AS max,
      {QS}, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM c_rec {G}""")
def _(t):
    return rec(t, I.numeric_stats(F.col("vals"), 288))


MOM = "count(value)::DOUBLE AS n, avg(value) AS m"


@query("series_pandas_moments", s="subject_id wk", f="sd var skew kurt lag1", sql=f"""
    WITH b AS (SELECT subject_id, wk, {MOM} FROM c_fin {G}),
    c AS (SELECT f.subject_id, f.wk, max(b.n) AS n, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4 FROM c_fin f JOIN b ON b.subject_id = f.subject_id AND b.wk = f.wk GROUP BY ALL),
    l AS (SELECT subject_id, wk, corr(value, prev) AS lag1, count(prev) AS np FROM (SELECT *, lag(value) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS prev FROM c_fin) {G})
    SELECT k.subject_id, k.wk, CASE WHEN n > 1 THEN sqrt(m2 * n / (n - 1)) END AS sd, CASE WHEN n > 1 THEN m2 * n / (n - 1) END AS var,
      CASE WHEN n > 2 AND m2 > 0 THEN m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) END AS skew,
      CASE WHEN n > 3 AND m2 > 0 THEN ((n + 1) * (m4 / m2 / m2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) END AS kurt,
      CASE WHEN np >= 2 AND isfinite(lag1) THEN lag1 END AS lag1
    FROM {ALLK} k LEFT JOIN c ON c.subject_id = k.subject_id AND c.wk = k.wk LEFT JOIN l ON l.subject_id = k.subject_id AND l.wk = k.wk""")
def _(t):
    d = t.recordings.withColumn("v", S.known(F.col("vals")))
    v = F.col("v")
    return d.select(*K, S.sd(v, 1).alias("sd"), S.var(v, 1).alias("var"), S.skewness_unbiased(v).alias("skew"),
                    S.kurtosis_unbiased(v).alias("kurt"), S.acf1(v).alias("lag1"))


@query("threshold_shares", s="subject_id wk", f="sedentary moderate vigorous ge_mid ge_high", sql=f"""
    SELECT subject_id, wk, avg((value <= 15)::INT) AS sedentary, avg((value > 15 AND value <= 30)::INT) AS moderate, avg((value > 30)::INT) AS vigorous, avg((value >= 30)::INT) AS ge_mid, avg((value >= 60)::INT) AS ge_high FROM c_rec {G}""")
def _(t):
    return rec(t, I.threshold_shares(F.col("vals"), 15, 30, 60))


@query("zero_ratio_nonzero_stats", s="subject_id wk", i="nonzero_count", f="zero_ratio nonzero_ratio nonzero_q10 nonzero_median nonzero_q90 nonzero_iqr", sql=f"""
    SELECT subject_id, wk, avg((z = 0)::INT) AS zero_ratio, count(*) FILTER (WHERE z > 0) AS nonzero_count, count(*) FILTER (WHERE z > 0) / nullif(count(z), 0)::DOUBLE AS nonzero_ratio,
      quantile_cont(z, 0.1) FILTER (WHERE z > 0) AS nonzero_q10, quantile_cont(z, 0.5) FILTER (WHERE z > 0) AS nonzero_median, quantile_cont(z, 0.9) FILTER (WHERE z > 0) AS nonzero_q90,
      quantile_cont(z, 0.75) FILTER (WHERE z > 0) - quantile_cont(z, 0.25) FILTER (WHERE z > 0) AS nonzero_iqr
    FROM (SELECT *, CASE WHEN code = 5 THEN 0 ELSE value END AS z FROM c_rec) {G}""")
def _(t):
    z = F.zip_with("vals", "codes", lambda v, c: F.when(c == 5, F.lit(0.0)).otherwise(v))
    d = t.recordings.withColumn("z", S.known(z)).withColumn("o", F.sort_array(F.filter("z", lambda x: x > 0)))
    o = F.col("o")
    return d.select(*K, S.share(F.col("z"), lambda x: x == 0).alias("zero_ratio"), F.size(o).alias("nonzero_count"),
                    F.try_divide(F.size(o), F.size("z")).alias("nonzero_ratio"), S.quantile(o, 0.1).alias("nonzero_q10"),
                    S.quantile(o, 0.5).alias("nonzero_median"), S.quantile(o, 0.9).alias("nonzero_q90"),
                    (S.quantile(o, 0.75) - S.quantile(o, 0.25)).alias("nonzero_iqr"))


@query("wear_mask", s="subject_id wk", i="n_worn longest_sedentary", f="mean_worn", sql=f"""
    WITH m AS (SELECT *, CASE WHEN code <> 5 AND value >= 5 THEN value END AS w FROM c_rec),
    r AS (SELECT subject_id, wk, max(length) AS l FROM ({islands('coalesce(w < 40, false)', 'm')}) WHERE f {G})
    SELECT a.subject_id, a.wk, n_worn, mean_worn, coalesce(l, 0) AS longest_sedentary FROM (SELECT subject_id, wk, count(w) AS n_worn, avg(w) AS mean_worn FROM m {G}) a LEFT JOIN r ON r.subject_id = a.subject_id AND r.wk = a.wk""")
def _(t):
    d = t.recordings.withColumn("w", F.zip_with("vals", "codes", lambda v, c: F.when((c != 5) & (v >= 5), v)))
    return d.select(*K, F.size(S.known(F.col("w"))).alias("n_worn"), S.mean(F.col("w")).alias("mean_worn"),
                    S.longest_run(F.col("w"), lambda x: x < 40).alias("longest_sedentary"))


@query("zero_run_gate", s="subject_id wk", i="zero_run passed", sql=f"""
    SELECT k.subject_id, k.wk, coalesce(max(r.length), 0) AS zero_run, coalesce(max(r.length), 0) <= 2 AS passed FROM {ALLK} k
    LEFT JOIN (SELECT * FROM ({islands('code = 5')}) WHERE f) r ON r.subject_id = k.subject_id AND r.wk = k.wk GROUP BY k.subject_id, k.wk""")
def _(t):
    z = F.transform("codes", lambda c: F.when(c == 5, 0).otherwise(c))
    d = t.recordings.select(*K, S.longest_run(z, lambda x: x == 0).alias("zero_run"))
    return d.withColumn("passed", F.col("zero_run") <= 2)


@query("sleep_onset_waso_awakenings", s="subject_id wk",
       f="onset_epochs waso_min awakenings frag_per_hour deep_bout_max rem_bout_max light_awake_per_hour deep_light_per_hour", sql=f"""
    WITH s AS (SELECT *, min(pos) FILTER (WHERE code <> 4) OVER (PARTITION BY subject_id, wk) AS onset, lag(code) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS prev FROM c_rec),
    rl AS ({islands('code')}),
    rm AS (SELECT subject_id, wk, coalesce(max(length) FILTER (WHERE f = 1), 0) * 5 AS deep, coalesce(max(length) FILTER (WHERE f = 3), 0) * 5 AS rem FROM rl {G}),
    a AS (SELECT subject_id, wk, max(n) AS n, max(onset) AS onset, count(*) FILTER (WHERE code = 4 AND pos >= onset) * 5 AS waso,
      count(*) FILTER (WHERE code = 4 AND pos >= onset AND prev IS DISTINCT FROM 4) AS awk, count(*) FILTER (WHERE prev <> code) AS chg,
      count(*) FILTER (WHERE prev = 2 AND code = 4) AS la, count(*) FILTER (WHERE prev = 1 AND code = 2) AS dl FROM s {G}),
    z AS (SELECT a.*, deep, rem, n >= 6 AND onset IS NOT NULL AS ok, n / 12.0::DOUBLE AS hrs FROM a JOIN rm ON rm.subject_id = a.subject_id AND rm.wk = a.wk)
    SELECT subject_id, wk, CASE WHEN ok THEN onset END AS onset_epochs, CASE WHEN ok THEN waso END AS waso_min, CASE WHEN ok THEN awk END AS awakenings, CASE WHEN ok THEN chg / hrs END AS frag_per_hour,
      CASE WHEN ok THEN deep END AS deep_bout_max, CASE WHEN ok THEN rem END AS rem_bout_max, CASE WHEN ok THEN la / greatest(hrs, 1) END AS light_awake_per_hour, CASE WHEN ok THEN dl / greatest(hrs, 1) END AS deep_light_per_hour FROM z""")
def _(t):
    return rec(t, I.night_structure(F.col("codes"), 5, 6))


@query("night_signal_metrics", s="subject_id wk", f="mean min max std cv slope_per_hour dip min_position", sql=f"""
    WITH a AS (SELECT subject_id, wk, count(*) AS n, avg(value) AS m, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS s, regr_slope(value, pos) * 12 AS sl,
      avg(value) FILTER (WHERE pos < greatest(6, n // 6)) AS early, arg_min(pos, (value, pos)) AS mp FROM c_fin {G})
    SELECT k.subject_id, k.wk, {', '.join(f'CASE WHEN a.n >= 6 THEN {e} END AS {c}' for c, e in (('mean', 'm'), ('min', 'lo'), ('max', 'hi'), ('std', 's'), ('cv', 's / m'), ('slope_per_hour', 'sl'), ('dip', 'early - lo'), ('min_position', 'mp / a.n::DOUBLE')))}
    FROM {ALLK} k LEFT JOIN a ON a.subject_id = k.subject_id AND a.wk = k.wk""")
def _(t):
    d = t.recordings.withColumn("v", F.filter("vals", lambda x: x > 0))
    return d.select(*K, *[e.alias(c) for c, e in I.night_signal(F.col("v"), 5, 6).items()])


@query("hr_drop", s="subject_id wk", f="hr_drop_ratio hr_drop_per_nrem_hour", sql=f"""
    WITH a AS (SELECT subject_id, wk, count(*) AS n, avg(value) FILTER (WHERE pos < 3) AS base, min(value) AS lo FROM c_fin {G}),
    b AS (SELECT subject_id, wk, count(*) FILTER (WHERE code IN (1, 2)) * 5 / 60.0::DOUBLE AS h FROM c_rec {G})
    SELECT b.subject_id, b.wk, CASE WHEN n >= 4 AND base > 0 THEN (base - lo) / base END AS hr_drop_ratio, CASE WHEN n >= 4 AND h > 0 THEN (base - lo) / h END AS hr_drop_per_nrem_hour
    FROM b LEFT JOIN a ON a.subject_id = b.subject_id AND a.wk = b.wk""")
def _(t):
    return rec(t, I.hr_drop(F.col("vals"), F.col("codes")))


@query("signal_pair_correlation", s="subject_id wk", f="r", sql=f"""
    SELECT subject_id, wk, CASE WHEN count(value) >= 4 AND stddev_pop(value) > 0 AND stddev_pop(CASE WHEN value IS NOT NULL THEN minute END) > 0 THEN corr(value, minute) END AS r FROM c_rec {G}""")
def _(t):
    return rec(t, {"r": S.corr(S.xy(F.col("vals"), F.col("mins")), 4)})


@query("m10_l5_ra_hourly", s="subject_id", i="m10_onset l5_onset", f="m10 l5 ra", sql="""
    WITH w AS (SELECT a.subject_id, a.hour AS h, avg(b.value) FILTER (WHERE (b.hour - a.hour + 24) % 24 < 10) AS w10, avg(b.value) FILTER (WHERE (b.hour - a.hour + 24) % 24 < 5) AS w5
      FROM c_prof a JOIN c_prof b ON a.subject_id = b.subject_id GROUP BY 1, 2),
    z AS (SELECT subject_id, max(w10) AS m10, min(w5) AS l5, arg_max(h, (w10, -h)) AS a, arg_min(h, (w5, h)) AS b FROM w GROUP BY 1)
    SELECT subject_id, m10, l5, (m10 - l5) / (m10 + l5) AS ra, (a + 4) % 24 AS m10_onset, (b + 4) % 24 AS l5_onset FROM z""")
def _(t):
    return t.hour_profiles.select("subject_id", *[e.alias(k) for k, e in I.most_least_active(F.col("profile"), start_hour=4).items()])


def win_sql(width: int, name: str) -> str:
    return (f"SELECT subject_id, date, max(m) AS {name}_max, min(m) AS {name}_min FROM (SELECT s.subject_id, s.date, s.st, avg(c.value) AS m FROM "
            f"(SELECT subject_id, date, unnest(range({1440 - width + 1})) AS st FROM (SELECT DISTINCT subject_id, date FROM c_min)) s "
            f"JOIN c_min c ON c.subject_id = s.subject_id AND c.date = s.date AND c.minute >= s.st AND c.minute < s.st + {width} WHERE c.value IS NOT NULL GROUP BY ALL) GROUP BY 1, 2")


@query("m10_l5_minute", s="subject_id date", f="m10 l5", sql=f"""
    SELECT k.subject_id, k.date, m10_max AS m10, l5_min AS l5 FROM (SELECT DISTINCT subject_id, date FROM c_min) k LEFT JOIN ({win_sql(600, 'm10')}) a ON a.subject_id = k.subject_id AND a.date = k.date
    LEFT JOIN ({win_sql(300, 'l5')}) b ON b.subject_id = k.subject_id AND b.date = k.date""")
def _(t):
    return I.window_extrema(t.day_arrays, DK, "mins", "vals", 600, 300, 0.001)


WAKE = """hit AS (SELECT s.subject_id, s.date, s.st FROM (SELECT subject_id, date, unnest(range(1411)) AS st FROM (SELECT DISTINCT subject_id, date FROM c_min)) s
      JOIN c_min c ON c.subject_id = s.subject_id AND c.date = s.date AND c.minute >= s.st AND c.minute < s.st + 30 WHERE c.value IS NOT NULL GROUP BY ALL HAVING avg(c.value) >= 30),
    ww AS (SELECT subject_id, date, min(st) AS onset, max(st) + 30 AS offs FROM hit GROUP BY 1, 2 HAVING max(st) + 30 - min(st) >= 240)"""


@query("wake_window", s="subject_id date", i="onset offset_minute", sql=f"""
    WITH {WAKE} SELECT k.subject_id, k.date, onset, offs AS offset_minute FROM (SELECT DISTINCT subject_id, date FROM c_min) k LEFT JOIN ww ON ww.subject_id = k.subject_id AND ww.date = k.date""")
def _(t):
    return I.wake_windows(t.day_arrays, DK, "mins", "vals", 30.0)


@query("sedentary_bouts_in_window", s="subject_id date", i="sed_total sed_longest sed_n", f="sed_mean", sql=f"""
    WITH {WAKE}, m AS (SELECT c.subject_id, c.date, c.minute FROM c_min c JOIN ww ON ww.subject_id = c.subject_id AND ww.date = c.date WHERE c.value < 60 AND c.minute >= onset AND c.minute < offs),
    r AS (SELECT subject_id, date, count(*) AS length FROM (SELECT *, minute - row_number() OVER (PARTITION BY subject_id, date ORDER BY minute) AS isl FROM m) GROUP BY subject_id, date, isl)
    SELECT k.subject_id, k.date, CASE WHEN ww.onset IS NOT NULL THEN coalesce(sum(length), 0) END AS sed_total, CASE WHEN ww.onset IS NOT NULL THEN coalesce(max(length), 0) END AS sed_longest,
      CASE WHEN ww.onset IS NOT NULL THEN count(length) END AS sed_n, avg(length) AS sed_mean
    FROM (SELECT DISTINCT subject_id, date FROM c_min) k LEFT JOIN ww ON ww.subject_id = k.subject_id AND ww.date = k.date LEFT JOIN r ON r.subject_id = k.subject_id AND r.date = k.date GROUP BY k.subject_id, k.date, ww.onset""")
def _(t):
    return I.wake_windows(t.day_arrays, DK, "mins", "vals", 30.0, sedentary=60.0)


DFT = "SELECT {k}, h, sqrt(pow(sum(value * cos(2 * pi() * h * pos / n)), 2) + pow(sum(value * sin(2 * pi() * h * pos / n)), 2)) AS amp FROM {src} WHERE h <= n // 2 GROUP BY {k}, h"


@query("first_harmonic_ratio", s="subject_id", f="ratio", sql=f"""
    SELECT subject_id, max(amp) FILTER (WHERE h = 1) / (sum(amp) + 1e-6) AS ratio FROM ({DFT.format(k='subject_id', src='(SELECT subject_id, hour AS pos, 24 AS n, value, unnest(range(1, 13)) AS h FROM c_pfill WHERE known >= 20)')}) GROUP BY 1
    UNION ALL SELECT DISTINCT subject_id, NULL FROM c_pfill WHERE known < 20""")
def _(t):
    d = t.hour_profiles.withColumn("p", S.circular_interpolate(F.col("profile"), 20))
    return d.select("subject_id", F.when(F.col("p").isNotNull(), I.first_harmonic(F.col("p"))).alias("ratio"))


@query("spectral_peak_ratio", s="subject_id wk", f="ratio", sql=f"""
    WITH c AS (SELECT *, value - avg(value) OVER (PARTITION BY subject_id, wk) AS v, stddev_pop(value) OVER (PARTITION BY subject_id, wk) AS s FROM c_fill),
    ok AS (SELECT subject_id, wk FROM c_fin {G} HAVING count(*) >= 8),
    x AS (SELECT c.subject_id, c.wk, pos, n, v AS value, unnest(range(1, n // 2 + 1)) AS h FROM c JOIN ok ON ok.subject_id = c.subject_id AND ok.wk = c.wk WHERE s > 1e-12)
    SELECT k.subject_id, k.wk, max(amp * amp) / sum(amp * amp) AS ratio FROM {ALLK} k LEFT JOIN ({DFT.format(k='subject_id, wk', src='x')}) d ON d.subject_id = k.subject_id AND d.wk = k.wk GROUP BY k.subject_id, k.wk""")
def _(t):
    d = t.recordings.withColumn("fill", S.interpolate(F.col("vals")))
    return d.select(*K, I.spectral_peak(F.col("fill"), F.size(S.known(F.col("vals")))).alias("ratio"))


@query("linear_interpolate", s="subject_id wk", i="pos", f="value", sql="SELECT subject_id, wk, pos, value FROM c_fill WHERE value IS NOT NULL")
def _(t):
    return t.recordings.select(*K, F.posexplode(S.interpolate(F.col("vals"))).alias("pos", "value"))


@query("circular_interpolate_hours", s="subject_id", i="hour", f="value", sql="SELECT subject_id, hour, value FROM c_pfill WHERE known >= 20")
def _(t):
    return t.hour_profiles.select("subject_id", F.posexplode(S.circular_interpolate(F.col("profile"), 20)).alias("hour", "value"))


@query("rank_axis_interpolation", s="subject_id wk", i="pos", f="value", sql="""
    WITH t AS (SELECT subject_id, wk, max(n) AS n, unnest(range(28)) AS j FROM c_fin GROUP BY subject_id, wk),
    h AS (SELECT *, j / 27.0::DOUBLE * (n - 1) AS h FROM t)
    SELECT h.subject_id, h.wk, j AS pos, a.value + (b.value - a.value) * (h - floor(h)) AS value FROM h
    JOIN c_fin a ON a.subject_id = h.subject_id AND a.wk = h.wk AND a.pos = CAST(floor(h) AS BIGINT) JOIN c_fin b ON b.subject_id = h.subject_id AND b.wk = h.wk AND b.pos = least(CAST(floor(h) AS BIGINT) + 1, h.n - 1)""")
def _(t):
    return t.recordings.select(*K, F.posexplode(S.resample_ranks(F.col("vals"), 28)).alias("pos", "value"))


@query("cosinor_fit", s="subject_id wk", f="mesor cos_coef sin_coef amplitude", sql=f"""
    WITH p AS (SELECT *, cos(minute / 60.0::DOUBLE * 2 * pi() / 24) AS c, sin(minute / 60.0::DOUBLE * 2 * pi() / 24) AS s FROM c_fin),
    m AS (SELECT subject_id, wk, count(*) AS n, avg(value) AS my, avg(c) AS mc, avg(s) AS ms, count(*) * var_pop(c) AS cc, count(*) * var_pop(s) AS ss, count(*) * covar_pop(c, s) AS cs,
      count(*) * covar_pop(value, c) AS yc, count(*) * covar_pop(value, s) AS ys FROM p {G}),
    b AS (SELECT *, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS b1, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b2 FROM m WHERE n >= 3 AND cc * ss - cs * cs > 1e-9)
    SELECT k.subject_id, k.wk, my - b1 * mc - b2 * ms AS mesor, b1 AS cos_coef, b2 AS sin_coef, sqrt(b1 * b1 + b2 * b2) AS amplitude FROM {ALLK} k LEFT JOIN b ON b.subject_id = k.subject_id AND b.wk = k.wk""")
def _(t):
    d = t.recordings.withColumn("c", S.cosinor(F.col("vals"), F.transform("mins", lambda m: m / F.lit(60.0))))
    return d.select(*K, "c.mesor", "c.cos_coef", "c.sin_coef", "c.amplitude")


@query("series_dynamics", s="subject_id wk", f="mad_diff rmssd zero_crossing hjorth_complexity iv acf1", sql=f"""
    WITH a AS (SELECT *, value - avg(value) OVER (PARTITION BY subject_id, wk) AS c, value - lag(value) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS d FROM c_fill WHERE value IS NOT NULL),
    b AS (SELECT *, d - lag(d) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS d2, lag(c) OVER (PARTITION BY subject_id, wk ORDER BY pos) AS pc FROM a),
    e AS (SELECT subject_id, wk, count(*) AS k, avg(abs(d)) AS mad_diff, sqrt(avg(d * d)) AS rmssd, count(*) FILTER (WHERE (c < 0) <> (pc < 0)) AS z, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(d2) AS v2, coalesce(sum(c * pc), 0) AS lg, sum(c * c) AS sq FROM b {G})
    SELECT q.subject_id, q.wk, mad_diff, rmssd, z / greatest(k - 1, 1)::DOUBLE AS zero_crossing, CASE WHEN v0 > 1e-12 AND v1 > 1e-12 AND v2 > 1e-12 THEN sqrt(v2 / v1) / sqrt(v1 / v0) END AS hjorth_complexity,
      CASE WHEN v0 > 1e-12 THEN v1 / v0 END AS iv, CASE WHEN v0 > 1e-12 THEN lg / sq END AS acf1 FROM {ALLK} q LEFT JOIN e ON e.subject_id = q.subject_id AND e.wk = q.wk""")
def _(t):
    d = t.recordings.withColumn("fill", S.interpolate(F.col("vals")))
    return d.select(*K, *[e.alias(k) for k, e in I.dynamics(F.col("fill")).items()])


@query("active_centroid_and_halves", s="subject_id wk", f="centroid first_half second_half", sql=f"""
    SELECT subject_id, wk, avg(CASE WHEN code >= 3 THEN pos END) / greatest(max(n) - 1, 1) AS centroid, avg(CASE WHEN pos < n // 2 THEN (code >= 3)::INT END) AS first_half,
      avg(CASE WHEN pos >= n // 2 THEN (code >= 3)::INT END) AS second_half FROM c_rec {G}""")
def _(t):
    return rec(t, I.active_position(F.col("codes"), 3))
