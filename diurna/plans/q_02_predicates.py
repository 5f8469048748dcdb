"""Projections, filters and missing-value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.functions import numbers as N
from diurna.functions import series as S
from diurna.operators import selection as P
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

XS = list(FEATURES)
DAYCOLS = ["v_max", "click_v", "purchase_v", "n", "is_weekend"]


@query("drop_forbidden_columns", s="name reason", sql="""
    SELECT name, CASE WHEN name = 'small ring' THEN 'exact' WHEN contains(name, 'lue') THEN 'substring'
      WHEN list_contains(regexp_split_to_array(name, '[^a-z0-9]+'), 'widget') THEN 'token' WHEN regexp_matches(name, '^red.*g$') THEN 'pattern' END AS reason
    FROM (SELECT DISTINCT lower(p_name) AS name FROM part)""")
def _(t):
    names = t.table("part").select(F.lower("p_name").alias("name")).distinct()
    return names.withColumn("reason", P.forbidden_reason(F.col("name"), ["small ring"], ["lue"], ["widget"], ["^red.*g$"]))


@query("is_sequence_like", s="name", i="is_sequence", f="share", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(CASE WHEN regexp_matches({c}, '[/,\\[\\]{{}}]') THEN 1.0::DOUBLE ELSE 0.0 END) AS share, "
    f"avg(CASE WHEN regexp_matches({c}, '[/,\\[\\]{{}}]') THEN 1.0::DOUBLE ELSE 0.0 END) > 0.05 AS is_sequence FROM {tb}"
    for c, tb in (("txt", "c_raw"), ("subject_id", "c_raw"), ("codes_txt", "c_raw"))))
def _(t):
    return P.sequence_like(t.raw_days, ["txt", "subject_id", "codes_txt"])


@query("select_numeric_columns", s="name", i="keep keep_few n_numeric", f="share", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(CASE WHEN isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN 1.0::DOUBLE ELSE 0.0 END) AS share, "
    f"avg(CASE WHEN isfinite(TRY_CAST(trim({c}) AS DOUBLE)) THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.5 AS keep, count(*) FILTER (WHERE isfinite(TRY_CAST(trim({c}) AS DOUBLE))) AS n_numeric, "
    f"count(*) FILTER (WHERE isfinite(TRY_CAST(trim({c}) AS DOUBLE))) >= greatest(5, ceil(0.01 * count(*))) AS keep_few FROM c_raw"
    for c in ("subject_id", "txt", "codes_txt")))
def _(t):
    return P.numeric_columns(t.raw_days, ["subject_id", "txt", "codes_txt"])


@query("drop_constant_columns", s="name", i="keep", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {e}) > 1 AS keep FROM c_day"
    for c, e in (("v_max", "v_max"), ("one", "1"), ("is_weekend", "is_weekend"), ("never", "CAST(NULL AS DOUBLE)"))))
def _(t):
    d = t.daily.withColumns({"one": F.lit(1), "never": F.lit(None).cast("double")})
    return P.varying_columns(d, ["v_max", "one", "is_weekend", "never"])


@query("drop_degenerate_columns", s="name", i="drop", f="present", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, count({e}) * 1.0::DOUBLE / count(*) AS present, count({e}) = 0 OR coalesce(stddev_pop({e}), 0) <= 1e-12 AS drop FROM c_day"
    for c, e in (("click_v", "click_v"), ("one", "1.0::DOUBLE"), ("never", "CAST(NULL AS DOUBLE)"))))
def _(t):
    d = t.daily.withColumns({"one": F.lit(1.0), "never": F.lit(None).cast("double")})
    return P.degenerate_columns(d, ["click_v", "one", "never"])


@query("drop_high_missing_columns", s="name", i="drop", f="missing", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.5 AS drop FROM c_day"
    for c in ("v_max", "click_v", "view_v", "purchase_v")))
def _(t):
    return P.missing_share(t.daily, ["v_max", "click_v", "view_v", "purchase_v"])


@query("filter_valid_interval", s="subject_id date", i="ep_id dur_s", sql="""
    SELECT subject_id, date, ep_id, dur_s FROM c_ep WHERE date_diff('second', start_ts, end_ts) > 0 AND dur_s <= 7200""")
def _(t):
    secs = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))
    return t.episodes.where((secs > 0) & (F.col("dur_s") <= 7200))


@query("inf_to_missing", i="event_id", f="x", sql="""
    SELECT event_id, CASE WHEN isfinite(v) THEN v END AS x FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'inf'::DOUBLE
      WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE value END AS v FROM events)""")
def _(t):
    k = F.col("event_id") % 9
    v = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).otherwise(F.col("value"))
    return t.events.select("event_id", N.known(v).alias("x"))


@query("zero_sentinel_to_missing", s="subject_id wk", i="n_all n_valid", f="total", sql="""
    SELECT subject_id, wk, count(*) AS n_all, count(*) FILTER (WHERE z > 0) AS n_valid, coalesce(sum(z) FILTER (WHERE z > 0), 0) AS total
    FROM (SELECT *, CASE WHEN code = 5 THEN 0 ELSE value END AS z FROM c_rec) GROUP BY 1, 2""")
def _(t):
    z = F.zip_with("vals", "codes", lambda v, c: F.when(c == 5, F.lit(0.0)).otherwise(v))
    return t.recordings.withColumn("z", z).select(
        "subject_id", "wk", F.size("z").alias("n_all"), S.count_if(F.col("z"), lambda x: x > 0).alias("n_valid"),
        S.total(F.filter("z", lambda x: x > 0)).alias("total"))


@query("out_of_domain_to_missing", s="subject_id", i="q1 q2 q3 total", sql="""
    SELECT subject_id, CASE WHEN a IN (1, 2) THEN a END AS q1, CASE WHEN b IN (1, 2) THEN b END AS q2, CASE WHEN c IN (1, 2) THEN c END AS q3,
      CASE WHEN a IN (1, 2) OR b IN (1, 2) OR c IN (1, 2) THEN a + b + c END AS total
    FROM (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_custkey % 3 AS a, c_nationkey % 3 AS b, CAST(floor(abs(c_acctbal)) AS BIGINT) % 3 AS c FROM customer)""")
def _(t):
    d = t.table("customer").select(
        F.col("c_custkey").cast("string").alias("subject_id"), (F.col("c_custkey") % 3).alias("q1"),
        (F.col("c_nationkey") % 3).alias("q2"), (F.floor(F.abs("c_acctbal")) % 3).alias("q3"))
    items = {q: P.domain_or_null(F.col(q), (1, 2)) for q in ("q1", "q2", "q3")}
    none = F.coalesce(*items.values()).isNull()
    return d.select("subject_id", *[e.alias(q) for q, e in items.items()],
                    F.when(~none, F.col("q1") + F.col("q2") + F.col("q3")).alias("total"))


@query("admit_day", s="subject_id wk", i="longest_gap admitted", f="worn", sql="""
    WITH f AS (SELECT subject_id, wk, pos, CASE WHEN value >= 10 THEN 1 ELSE 0 END AS worn,
        CASE WHEN coalesce(value, 0) < 20 THEN 1 ELSE 0 END AS zero FROM c_rec),
    g AS (SELECT *, pos - row_number() OVER (PARTITION BY subject_id, wk, zero ORDER BY pos) AS isl FROM f),
    r AS (SELECT subject_id, wk, max(c) AS longest_gap FROM (SELECT subject_id, wk, isl, count(*) AS c FROM g WHERE zero = 1 GROUP BY ALL) GROUP BY 1, 2),
    w AS (SELECT subject_id, wk, avg(worn) AS worn FROM f GROUP BY 1, 2)
    SELECT w.subject_id, w.wk, worn, coalesce(longest_gap, 0) AS longest_gap, worn >= 0.6 AND coalesce(longest_gap, 0) <= 3 AS admitted
    FROM w LEFT JOIN r ON w.subject_id = r.subject_id AND w.wk = r.wk""")
def _(t):
    v = F.transform("vals", lambda x: F.coalesce(x, F.lit(0.0)))
    d = t.recordings.select("subject_id", "wk", S.share(v, lambda x: x >= 10).alias("worn"),
                            S.longest_run(v, lambda x: x < 20).alias("longest_gap"))
    return d.withColumn("admitted", (F.col("worn") >= 0.6) & (F.col("longest_gap") <= 3))


@query("min_observations_filter", s="subject_id date", f="v_max", sql="""
    SELECT subject_id, date, v_max FROM c_day WHERE subject_id IN (SELECT subject_id FROM c_day GROUP BY 1 HAVING count(*) >= 27)""")
def _(t):
    return P.min_observations(t.daily, "subject_id", 27)


def bounds(tail: float) -> str:
    return ", ".join(f"quantile_cont({c}, {tail}) AS lo_{c}, quantile_cont({c}, {1 - tail}) AS hi_{c}" for c in XS)


BOUNDS, WIDE = bounds(0.05), bounds(0.005)  # with all columns judged, 5 percent tails leave no row
KEEP = " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in XS)
CLIPS = ", ".join(f"greatest(least({c}, hi_{c}), lo_{c}) AS {c}" for c in XS)
NCLIP = " + ".join(f"CAST({c} < lo_{c} OR {c} > hi_{c} AS INTEGER)" for c in XS)


@query("percentile_outlier_drop", s="scope", i="vec_id", sql=f"""
    SELECT 'global' AS scope, vec_id FROM c_vec, (SELECT {WIDE} FROM c_vec) AS b WHERE {KEEP}
    UNION ALL SELECT 'per_class', vec_id FROM c_vec JOIN (SELECT y3, {WIDE} FROM c_vec GROUP BY y3) AS b USING (y3) WHERE {KEEP}""")
def _(t):
    a = P.drop_outliers(t.vectors, XS, 0.005).select(F.lit("global").alias("scope"), "vec_id")
    return a.unionAll(P.drop_outliers(t.vectors, XS, 0.005, ["y3"]).select(F.lit("per_class").alias("scope"), "vec_id"))


@query("percentile_outlier_clip", i="vec_id n_clipped", f=" ".join(XS), sql=f"""
    SELECT vec_id, {CLIPS}, {NCLIP} AS n_clipped FROM c_vec, (SELECT {BOUNDS} FROM c_vec) AS b""")
def _(t):
    return P.clip_outliers(t.vectors, XS, 0.05)


@query("percentile_retention_scan", i="y3 n_before n_kept", f="q", sql=" UNION ALL ".join(
    f"SELECT {q} AS q, y3, count(*) AS n_before, sum(CASE WHEN " + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in XS)
    + " THEN 1 ELSE 0 END) AS n_kept FROM c_vec, (SELECT "
    + ", ".join(f"quantile_cont({c}, {q}) AS lo_{c}, quantile_cont({c}, {1 - q}) AS hi_{c}" for c in XS) + " FROM c_vec) AS b GROUP BY y3"
    for q in (0.01, 0.05, 0.1)))
def _(t):
    return P.retention_scan(t.vectors, XS, (0.01, 0.05, 0.1), "y3")
