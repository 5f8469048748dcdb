"""Window functions and sequence building."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from diurna.operators import sequences as Q
from diurna.operators.radix import quantiles
from diurna.operators.ranking import one_row
from diurna.plans.registry import query

K = ["subject_id", "channel"]
P = "PARTITION BY subject_id, channel ORDER BY day_index"


@query("rolling_mean_std", s="subject_id channel", i="day_index", f="roll_mean roll_std", sql=f"""
    SELECT subject_id, channel, day_index, avg(value) OVER w AS roll_mean, coalesce(stddev_samp(value) OVER w, 0) AS roll_std FROM c_long WINDOW w AS ({P} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    return Q.rolling(t.long, K, "day_index", "value")


@query("rolling_std_min_periods", s="subject_id channel", i="day_index", f="sd3 sd4 sd6", sql=f"""
    SELECT subject_id, channel, day_index, {', '.join(f'CASE WHEN count(value) OVER w >= {k} THEN stddev_pop(value) OVER w END AS sd{k}' for k in (3, 4, 6))} FROM c_long WINDOW w AS ({P} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t):
    return t.long.withColumns({f"sd{k}": Q.rolling_std(t.long, K, "day_index", "value", 7, k) for k in (3, 4, 6)})


@query("ffill_bfill", s="subject_id channel", i="day_index", f="filled", sql=f"""
    SELECT subject_id, channel, day_index, coalesce(last_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM c_long""")
def _(t):
    return t.long.withColumn("filled", Q.fill_both_ways(K, "day_index", "value"))


@query("cumulative_count", s="subject_id date", i="k", sql="SELECT subject_id, date, row_number() OVER (PARTITION BY subject_id ORDER BY date) - 1 AS k FROM c_slp")
def _(t):
    return t.sleep.withColumn("k", F.row_number().over(Window.partitionBy("subject_id").orderBy("date")) - 1)


ISL = "SELECT *, date - CAST(row_number() OVER (PARTITION BY subject_id ORDER BY date) AS INTEGER) AS isl FROM c_slp"


@query("consecutive_runs", s="subject_id run_start run_end", i="n", sql=f"SELECT subject_id, min(date) AS run_start, max(date) AS run_end, count(*) AS n FROM ({ISL}) GROUP BY subject_id, isl")
def _(t):
    return Q.with_runs(t.sleep, "subject_id", "date").groupBy("subject_id", "run_start").agg(F.max("date").alias("run_end"), F.count("*").alias("n"))


def lead_sql(part: str, src: str, length: int) -> str:
    cols = ", ".join(f"lead(day_index, {k}) OVER w AS i{k}, lead(v_max, {k}) OVER w AS v{k}, lead(date, {k}) OVER w AS d{k}" for k in range(length))
    return f"SELECT subject_id, date AS start_date, {cols}, row_number() OVER w - 1 AS p FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY date)"


# Sleep days: they have gaps of their own.
DRUN = """(SELECT subject_id, date, slp_max AS v_max, date_diff('day', min(date) OVER (PARTITION BY subject_id), date) AS day_index,
  date - CAST(row_number() OVER (PARTITION BY subject_id ORDER BY date) AS INTEGER) AS isl FROM c_slp)"""


def sleep_days(t):
    first = F.min("date").over(Window.partitionBy("subject_id"))
    return t.sleep.select("subject_id", "date", F.col("slp_max").alias("v_max"), F.datediff("date", first).alias("day_index"))


def wins(t, length, stride=1, consecutive=True):
    return Q.windows(sleep_days(t), "subject_id", "date", "day_index", ["v_max"], length, stride, consecutive)


def ids(days="days"):
    return F.concat_ws(",", F.transform(days, lambda x: x["row_id"].cast("string")))


@query("windows_consecutive", s="subject_id start_date end_date ids", i="is_consecutive", sql=f"""
    SELECT subject_id, start_date, d2 AS end_date, concat_ws(',', i0, i1, i2) AS ids, 1 AS is_consecutive FROM ({lead_sql('subject_id, isl', DRUN, 3)}) WHERE d2 IS NOT NULL AND p % 2 = 0""")
def _(t):
    return wins(t, 3, 2).withColumn("ids", ids())


@query("windows_gluing_gaps", s="subject_id start_date end_date ids", i="is_consecutive", sql=f"""
    SELECT subject_id, start_date, d2 AS end_date, concat_ws(',', i0, i1, i2) AS ids, d2 - start_date = 2 AS is_consecutive FROM ({lead_sql('subject_id', DRUN, 3)}) WHERE d2 IS NOT NULL""")
def _(t):
    return wins(t, 3, 1, False).withColumn("ids", ids())


@query("windows_literal_leak_report", i="n_windows n_crossing n_gap n_test n_shared_dates n_test_dates", f="leak_share", sql=f"""
    WITH w AS (SELECT z.*, cut FROM ({lead_sql('subject_id', DRUN, 3)}) z JOIN (SELECT subject_id, max(date) - 6 AS cut FROM c_slp GROUP BY 1) c ON c.subject_id = z.subject_id WHERE d2 IS NOT NULL),
    f AS (SELECT *, d0 >= cut AS al, d2 >= cut AS an FROM w),
    dt AS (SELECT subject_id, d, max(al::INT) AS mx, min(al::INT) AS mn FROM (SELECT subject_id, al, unnest([d0, d1, d2]) AS d FROM f) GROUP BY 1, 2)
    SELECT *, n_shared_dates / n_test_dates::DOUBLE AS leak_share FROM (SELECT count(*) AS n_windows, count(*) FILTER (WHERE an AND NOT al) AS n_crossing, count(*) FILTER (WHERE d2 - d0 > 2) AS n_gap, count(*) FILTER (WHERE al) AS n_test FROM f),
      (SELECT count(*) FILTER (WHERE mx = 1 AND mn = 0) AS n_shared_dates, count(*) FILTER (WHERE mx = 1) AS n_test_dates FROM dt)""")
def _(t):
    cuts = t.sleep.groupBy("subject_id").agg(F.date_sub(F.max("date"), 6).alias("cut"))
    return Q.leak_report(wins(t, 3, 1, False), cuts, "subject_id")


@query("gap_spanning_share", i="length n_windows n_gap subjects_with_gap total_gaps runs_max longest_min", f="share runs_median longest_median", sql=f"""
    WITH l AS (SELECT length, s FROM (SELECT unnest([3, 4, 5, 7]) AS length, unnest([date - lag(date, 2) OVER w, date - lag(date, 3) OVER w, date - lag(date, 4) OVER w, date - lag(date, 6) OVER w]) AS s FROM c_slp WINDOW w AS (PARTITION BY subject_id ORDER BY date)) WHERE s IS NOT NULL),
    r AS (SELECT subject_id, count(*) AS runs, max(n) AS longest FROM (SELECT subject_id, isl, count(*) AS n FROM ({ISL}) GROUP BY 1, 2) GROUP BY 1)
    SELECT * FROM (SELECT length, count(*) AS n_windows, count(*) FILTER (WHERE s > length - 1) AS n_gap, avg((s > length - 1)::INT) AS share FROM l GROUP BY 1),
      (SELECT count(*) FILTER (WHERE runs > 1) AS subjects_with_gap, sum(runs - 1) AS total_gaps, median(runs) AS runs_median, max(runs) AS runs_max, min(longest) AS longest_min, median(longest) AS longest_median FROM r)""")
def _(t):
    return Q.gap_spanning(t.sleep, "subject_id", "date", (3, 4, 5, 7))


@query("padding_share", s="feature", f="share", sql="""
    WITH p AS (SELECT subject_id, unnest(range(25)) AS k FROM c_subj), a AS (SELECT p.subject_id, p.k, d.subject_id IS NULL AS pad FROM p LEFT JOIN (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY date) - 1 AS r FROM c_slp) d ON d.subject_id = p.subject_id AND d.r = p.k)
    SELECT unnest(['slp_max', 'slp_n', 'overall']) AS feature, avg(pad::INT) AS share FROM a""")
def _(t):
    s = Q.padded_sequence(t.sleep, "subject_id", "date", ["slp_max", "slp_n"], 25, "first", "right")
    cells = s.select(F.explode("steps").alias("x")).agg(*[F.avg((F.col(f"x.{c}") == -1).cast("double")).alias(c) for c in ("slp_max", "slp_n")],
                                                      F.avg(((F.col("x.slp_max") == -1).cast("double") + (F.col("x.slp_n") == -1).cast("double")) / 2).alias("overall"))
    return cells.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in ("slp_max", "slp_n", "overall")])))


@query("padded_subject_sequence", s="subject_id", i="pos mask t_min t_max", f="v_max click_v t_median", sql="""
    WITH d AS (SELECT subject_id, v_max, click_v, row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) AS r FROM c_day)
    SELECT k.subject_id, k.pos, d.r IS NOT NULL AS mask, CASE WHEN d.r IS NULL THEN -1 ELSE v_max END AS v_max, CASE WHEN d.r IS NULL THEN -1 ELSE click_v END AS click_v, t_min, t_median, t_max
    FROM (SELECT min(t) AS t_min, median(t) AS t_median, max(t) AS t_max FROM (SELECT count(*) AS t FROM c_day GROUP BY subject_id)), (SELECT subject_id, unnest(range(28)) AS pos FROM c_subj) k LEFT JOIN d ON d.subject_id = k.subject_id AND d.r = 28 - k.pos""")
def _(t):
    s = Q.padded_sequence(t.daily, "subject_id", "date", ["v_max", "click_v"], 28)
    steps = s.select("subject_id", F.posexplode("steps").alias("pos", "x")).select("subject_id", "pos", "x.mask", "x.v_max", "x.click_v")
    return steps.transform(one_row, Q.length_facts(t.daily, "subject_id"))


@query("flatten_window", s="subject_id start_date", f="v_max__t0 v_max__t1 v_max__t2 v_max__mean v_max__last", sql=f"""
    SELECT subject_id, start_date, v0 AS v_max__t0, v1 AS v_max__t1, v2 AS v_max__t2, (v0 + v1 + v2) / 3 AS v_max__mean, v2 AS v_max__last FROM ({lead_sql('subject_id, isl', DRUN, 3)}) WHERE d2 IS NOT NULL""")
def _(t):
    w = wins(t, 3)
    k = ["subject_id", "start_date", "days"]
    a = Q.flatten(w, k, ["v_max"], 3)
    return Q.flatten(a, a.columns[:2] + ["days"] + a.columns[3:], ["v_max"], 3, "mean").withColumn("v_max__last", F.element_at("days", -1)["v_max"])


@query("subject_zscore", s="subject_id channel", i="day_index", f="z", sql="""
    SELECT subject_id, channel, day_index, CASE WHEN count(value) OVER w < 2 THEN 0 ELSE coalesce((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 0) END AS z FROM c_long WINDOW w AS (PARTITION BY subject_id, channel)""")
def _(t):
    return t.long.withColumn("z", Q.own_zscore(K, "value"))


@query("midrank_percentile", i="window_id", f="pct", sql="""
    SELECT window_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER () AS pct FROM c_ord""")
def _(t):
    return Q.midrank_percentile(t.order_scores, [], "score")


@query("reference_ecdf", s="model subject_id", i="seed", f="ecdf", sql="""
    WITH r AS (SELECT model, seed, score FROM c_oof WHERE fold <> 0), q AS (SELECT model, seed, subject_id, score FROM c_oof WHERE fold = 0)
    SELECT q.model, q.seed, subject_id, (count(*) FILTER (WHERE r.score < q.score) + count(*) FILTER (WHERE r.score <= q.score)) / (2.0::DOUBLE * count(*)) AS ecdf FROM q JOIN r ON r.model = q.model AND r.seed = q.seed GROUP BY 1, 2, 3""")
def _(t):
    d = t.oof.select("model", "seed", "subject_id", "score", "fold")
    return Q.reference_ecdf(d.where("fold <> 0").drop("fold"), d.where("fold = 0").drop("fold"), "score", ["model", "seed"])


@query("quintile_bins", s="feature", i="bin n", f="value_min value_median value_max mean_contribution median_contribution", sql="""
    WITH e AS (SELECT feature, list_sort(list_distinct([min(value), quantile_cont(value, 0.2), quantile_cont(value, 0.4), quantile_cont(value, 0.6), quantile_cont(value, 0.8), max(value)])) AS e FROM c_contrib GROUP BY 1),
    b AS (SELECT c.*, len(list_filter(e[2:len(e) - 1], lambda z: z < value)) AS bin FROM c_contrib c JOIN e ON e.feature = c.feature)
    SELECT feature, bin, count(*) AS n, min(value) AS value_min, median(value) AS value_median, max(value) AS value_max, avg(contribution) AS mean_contribution, median(contribution) AS median_contribution FROM b GROUP BY 1, 2""")
def _(t):
    b = Q.quantile_bins(t.contributions, ["feature"], "value", 5)
    g = b.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
                                        F.avg("contribution").alias("mean_contribution"))
    mv = quantiles(b, ["feature", "bin"], "value", {"value_median": 0.5}).drop("n")
    mc = quantiles(b, ["feature", "bin"], "contribution", {"median_contribution": 0.5}).drop("n")
    return g.join(mv, ["feature", "bin"]).join(mc, ["feature", "bin"])
