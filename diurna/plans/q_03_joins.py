"""Joins, deduplication, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from diurna.operators import dedup as D
from diurna.operators import joins as J
from diurna.plans.registry import query


@query("join_activity_sleep_day", s="subject_id date", i="act_n slp_n", f="act_max slp_max", sql="""
    SELECT a.subject_id, a.date, act_n, slp_n, act_max, slp_max FROM c_act a JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date""")
def _(t):
    return J.join_modalities(t.activity, t.sleep)


@query("join_labels_left_checked", s="subject_id date diag", i="label_missing", sql="""
    SELECT a.subject_id, a.date, l.diag, CASE WHEN l.diag IS NULL THEN 1 ELSE 0 END AS label_missing
    FROM c_act a LEFT JOIN (SELECT * FROM c_subj WHERE CAST(subject_id AS BIGINT) % 13 <> 4) l ON a.subject_id = l.subject_id""")
def _(t):
    labels = t.subjects.where(F.col("subject_id").cast("bigint") % 13 != 4).select("subject_id", "diag")
    return J.join_labels(t.activity, labels, "subject_id", "diag")


@query("join_outer_indicator", s="subject_id", i="both left_only right_only", sql="""
    SELECT coalesce(a.subject_id, s.subject_id) AS subject_id, count(*) FILTER (WHERE a.date IS NOT NULL AND s.date IS NOT NULL) AS both,
      count(*) FILTER (WHERE s.date IS NULL) AS left_only, count(*) FILTER (WHERE a.date IS NULL) AS right_only
    FROM c_act a FULL JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date GROUP BY 1""")
def _(t):
    p = J.presence(t.activity, t.sleep, ["subject_id", "date"])
    return p.groupBy("subject_id").agg(*[F.sum((F.col("side") == k).cast("int")).alias(k) for k in ("both", "left_only", "right_only")])


@query("join_positional", s="subject_id date date_s", i="pos", sql="""
    SELECT a.subject_id, a.pos, a.date, s.date AS date_s FROM
      (SELECT subject_id, date, row_number() OVER (PARTITION BY subject_id ORDER BY date) - 1 AS pos FROM c_act) a
      JOIN (SELECT subject_id, date, row_number() OVER (PARTITION BY subject_id ORDER BY date) - 1 AS pos FROM c_slp) s
      ON a.subject_id = s.subject_id AND a.pos = s.pos""")
def _(t):
    s = t.sleep.select("subject_id", F.col("date").alias("date_s"))
    return J.positional_join(t.activity.select("subject_id", "date"), s, "subject_id", "date", "date_s")


@query("semi_anti_days", s="subject_id date kind", sql="""
    SELECT subject_id, date, 'activity_only' AS kind FROM c_act a WHERE NOT EXISTS (SELECT 1 FROM c_slp s WHERE s.subject_id = a.subject_id AND s.date = a.date)
    UNION ALL SELECT subject_id, date, 'sleep_only' FROM c_slp a WHERE NOT EXISTS (SELECT 1 FROM c_act s WHERE s.subject_id = a.subject_id AND s.date = a.date)
    UNION ALL SELECT subject_id, date, 'labelled' FROM c_act WHERE subject_id IN (SELECT subject_id FROM c_subj WHERE y3 = 1)""")
def _(t):
    k = ["subject_id", "date"]
    a, s = t.activity.select(*k), t.sleep.select(*k)
    return (a.join(s, k, "left_anti").withColumn("kind", F.lit("activity_only"))
            .unionByName(s.join(a, k, "left_anti").withColumn("kind", F.lit("sleep_only")))
            .unionByName(a.join(t.subjects.where("y3 = 1"), "subject_id", "left_semi").withColumn("kind", F.lit("labelled"))))


@query("calendar_grid_join", s="subject_id date", i="act_n", sql="""
    SELECT g.subject_id, g.date, a.act_n FROM (SELECT subject_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM c_act GROUP BY subject_id) g
    LEFT JOIN c_act a ON a.subject_id = g.subject_id AND a.date = g.date""")
def _(t):
    return J.calendar_grid(t.activity.select("subject_id", "date", "act_n"), "subject_id", "date")


@query("lookback_range_join", s="subject_id", i="width days", f="top", sql="""
    SELECT d.subject_id, w.width, count(*) AS days, max(d.v_max) AS top FROM c_day d JOIN (SELECT subject_id, max(date) AS anchor FROM c_act GROUP BY 1) a ON a.subject_id = d.subject_id,
      (VALUES (7), (14), (28)) AS w(width) WHERE d.date BETWEEN a.anchor - w.width + 1 AND a.anchor GROUP BY 1, 2""")
def _(t):
    anchors = t.activity.groupBy("subject_id").agg(F.max("date").alias("anchor"))
    d = J.lookbacks(t.daily.select("subject_id", "date", "v_max"), anchors, "subject_id", "date", (7, 14, 28))
    return d.groupBy("subject_id", "width").agg(F.count("*").alias("days"), F.max("v_max").alias("top"))


@query("interval_to_minute_grid", s="subject_id date channel", i="minute", f="value", sql="""
    WITH ser AS (SELECT subject_id, 'met' AS channel, value, 0 AS ord, date_diff('day', DATE '1970-01-01', date) * 1440 + minute AS am FROM c_min),
    iv AS (SELECT subject_id, 'sleep' AS channel, value, date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', start_ts)) AS ord,
      CAST(ceil(s0 / 60.0) AS BIGINT) - 240 AS lo, CAST(ceil(s1 / 60.0) AS BIGINT) - 241 AS hi
      FROM (SELECT *, floor(epoch(start_ts)) AS s0, floor(epoch(end_ts)) AS s1 FROM c_ep)),
    px AS (SELECT subject_id, channel, value, ord, unnest(generate_series(lo, hi)) AS am FROM iv WHERE hi >= lo),
    al AS (SELECT * FROM ser UNION ALL SELECT * FROM px),
    rk AS (SELECT *, row_number() OVER (PARTITION BY subject_id, channel, am ORDER BY ord DESC, value DESC NULLS LAST) AS rn FROM al)
    SELECT subject_id, channel, DATE '1970-01-01' + CAST(am // 1440 AS INTEGER) AS date, am % 1440 AS minute, value FROM rk WHERE rn = 1""")
def _(t):
    s = t.minutes.select("subject_id", "date", F.col("minute").alias("pos"), F.lit("met").alias("channel"), "value")
    iv = t.episodes.select("subject_id", "start_ts", "end_ts", F.lit("sleep").alias("channel"), "value")
    return J.minute_grid(s, iv)


@query("align_window_sets", s="subject_id wk", i="n_act n_slp", sql="""
    SELECT subject_id, wk, n_act, n_slp FROM (SELECT subject_id, date_trunc('week', date)::DATE AS wk, count(*) AS n_act FROM c_act GROUP BY 1, 2)
    JOIN (SELECT subject_id, date_trunc('week', date)::DATE AS wk, count(*) AS n_slp FROM c_slp GROUP BY 1, 2 HAVING count(*) >= 3) USING (subject_id, wk)""")
def _(t):
    def weekly(df, n):
        return df.groupBy("subject_id", F.date_trunc("week", "date").cast("date").alias("wk")).agg(F.count("*").alias(n))

    return J.join_modalities(weekly(t.activity, "n_act"), weekly(t.sleep, "n_slp").where("n_slp >= 3"), ["subject_id", "wk"])


@query("adjacent_day_pairs", s="subject_id date", f="v_max prev", sql="""
    SELECT b.subject_id, b.date, b.v_max, a.v_max AS prev FROM c_day a JOIN c_day b ON a.subject_id = b.subject_id AND b.date = a.date + 1""")
def _(t):
    return J.adjacent_days(t.daily, "subject_id", "date", "v_max")


# ---------------------------------------------------------------- dedup and top-k
@query("dedup_longest", s="subject_id date", i="ep_id dur_s", sql="""
    SELECT subject_id, date, ep_id, dur_s FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY dur_s DESC, start_ts, end_ts) AS rn FROM c_ep) WHERE rn = 1""")
def _(t):
    return D.longest_episode(t.episodes, ["subject_id", "date"], "dur_s", "start_ts", "end_ts")


@query("dedup_policy", s="policy subject_id date", i="ep_id", sql=" UNION ALL ".join(
    f"SELECT '{p}' AS policy, subject_id, date, ep_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY {o}) AS rn FROM c_ep) WHERE rn = 1"
    for p, o in (("longest_duration", "dur_s DESC, start_ts, ep_id"), ("latest_bedtime_end", "end_ts DESC, ep_id DESC"), ("first", "ep_id"))))
def _(t):
    out = None
    for p in ("longest_duration", "latest_bedtime_end", "first"):
        d = D.dedup_policy(t.episodes, ["subject_id", "date"], p, "dur_s", "start_ts", "end_ts", "ep_id").select(
            F.lit(p).alias("policy"), "subject_id", "date", "ep_id")
        out = d if out is None else out.unionAll(d)
    return out


@query("dedup_keep_last", s="subject_id date event_type", i="event_id", sql="""
    SELECT subject_id, date, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS date, event_id, event_type,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return D.keep_last(t.events.select("subject_id", "date", "ts", "event_id", "event_type"), ["subject_id", "date"],
                       {"t": F.col("ts"), "i": F.col("event_id")})


@query("collapse_same_day_median", s="subject_id date", f="value code", sql="""
    SELECT subject_id, date, quantile_cont(value, 0.5) AS value, quantile_cont(code, 0.5) AS code FROM c_min GROUP BY 1, 2""")
def _(t):
    return D.collapse_median(t.minutes, ["subject_id", "date"], ["value", "code"])


@query("collapse_same_day_mean_or_sum", s="subject_id date", f="met_score steps", sql="""
    SELECT subject_id, date, avg(value) AS met_score, sum(code) AS steps FROM c_min GROUP BY 1, 2""")
def _(t):
    d = t.minutes.withColumnsRenamed({"value": "met_score", "code": "steps"})
    return D.collapse_by_rule(d, ["subject_id", "date"], ["met_score", "steps"])


@query("last_n_events", s="subject_id", i="event_id rn", sql="""
    SELECT subject_id, event_id, rn FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 28""")
def _(t):
    return D.last_n(t.events, "subject_id", 28, F.col("ts").desc(), F.col("event_id").desc())


@query("first_n_days", s="subject_id date", i="rn", sql="""
    SELECT subject_id, date, rn FROM (SELECT a.subject_id, a.date, row_number() OVER (PARTITION BY a.subject_id ORDER BY a.date) AS rn, count(*) OVER (PARTITION BY a.subject_id) AS n
      FROM c_act a JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date) WHERE rn <= 15 AND n >= 15""")
def _(t):
    return D.first_n_or_refuse(J.join_modalities(t.activity, t.sleep), "subject_id", "date", 15)


@query("top_k_effects", s="feature", i="y3 rn", f="effect", sql="""
    SELECT feature, y3, effect, rn FROM (SELECT *, row_number() OVER (PARTITION BY y3 ORDER BY abs(effect) DESC, feature) AS rn FROM (
      SELECT y3, feature, avg(value) - (SELECT avg(value) FROM c_vl z WHERE z.feature = v.feature) AS effect FROM c_vl v GROUP BY y3, feature)) WHERE rn <= 3""")
def _(t):
    g = t.vector_long.groupBy("y3", "feature").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    w = Window.partitionBy("feature")
    e = g.withColumn("effect", F.col("s") / F.col("c") - F.sum("s").over(w) / F.sum("c").over(w))
    return D.top_k(e, ["y3"], 3, F.abs("effect").desc(), F.col("feature"))


@query("largest_daily_changes", s="subject_id channel", i="day_index", f="change", sql="""
    SELECT subject_id, channel, day_index, change FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, channel ORDER BY abs(change) DESC, day_index) AS rn FROM (
      SELECT b.subject_id, b.channel, b.day_index, b.value - a.value AS change FROM c_long a JOIN c_long b ON a.subject_id = b.subject_id AND a.channel = b.channel AND b.day_index = a.day_index + 1
      WHERE a.value IS NOT NULL AND b.value IS NOT NULL)) WHERE rn <= 3""")
def _(t):
    return D.largest_changes(t.long, 3)


@query("evenly_spaced_sample", s="subject_id", i="day_index pos", f="v_max", sql="""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day_index) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS k FROM c_day)
    SELECT subject_id, day_index, v_max, pos FROM d WHERE k <= 12 OR pos IN (SELECT CAST(round_even(i * (d.k - 1) / 11.0::DOUBLE, 0) AS BIGINT) FROM (SELECT unnest(range(12)) AS i))""")
def _(t):
    return D.evenly_spaced(t.daily, "subject_id", "day_index", 12)


# ---------------------------------------------------------------- set operations
@query("split_overlap_intersect", s="subject_id", sql="""
    SELECT subject_id FROM c_day WHERE day_index < 3 AND n > 4 INTERSECT SELECT subject_id FROM c_day WHERE day_index > 20 AND n > 5""")
def _(t):
    return t.daily.where("day_index < 3 and n > 4").select("subject_id").intersect(
        t.daily.where("day_index > 20 and n > 5").select("subject_id"))


@query("feature_set_symmetric_difference", s="name side", sql="""
    SELECT name, 'missing' AS side FROM (SELECT DISTINCT event_type AS name FROM events WHERE user_id % 2 = 0 EXCEPT SELECT DISTINCT event_type FROM events WHERE event_id % 5 = 0 AND event_type <> 'view')
    UNION ALL SELECT name, 'extra' FROM (SELECT DISTINCT event_type || '' AS name FROM events EXCEPT SELECT DISTINCT event_type FROM events WHERE event_type <> 'click')""")
def _(t):
    e = t.events.select(F.col("event_type").alias("name"), "user_id", "event_id")
    full = e.select("name").distinct()
    a = e.where("user_id % 2 = 0").select("name").distinct().exceptAll(
        e.where("event_id % 5 = 0 and name <> 'view'").select("name").distinct())
    b = full.exceptAll(full.where("name <> 'click'"))
    return a.withColumn("side", F.lit("missing")).unionByName(b.withColumn("side", F.lit("extra")))


@query("row_id_overlap", i="event_id", sql="""
    SELECT event_id FROM events WHERE value > 50 AND event_id IN (SELECT event_id FROM events WHERE event_type = 'view')""")
def _(t):
    return t.events.where("value > 50").select("event_id").join(t.events.where("event_type = 'view'").select("event_id"), "event_id", "left_semi")


@query("subject_date_overlap", s="subject_id date", sql="""
    SELECT subject_id, date FROM (SELECT subject_id, unnest(list(date)) AS date FROM c_act GROUP BY 1) INTERSECT SELECT subject_id, date FROM c_slp""")
def _(t):
    a = t.recordings.select("subject_id", F.explode(F.array_distinct("dates")).alias("date"))
    a = a.join(t.activity.select("subject_id", "date"), ["subject_id", "date"], "left_semi")
    return a.intersect(t.sleep.select("subject_id", "date"))


@query("union_all_parts", s="subject_id date part", sql="""
    SELECT subject_id, date, 'train' AS part FROM c_day WHERE day_index < 20 UNION ALL SELECT subject_id, date, 'validation' FROM c_day WHERE day_index BETWEEN 20 AND 22
    UNION ALL SELECT subject_id, date, 'test' FROM c_day WHERE day_index > 22""")
def _(t):
    d = t.daily.select("subject_id", "date", "day_index")
    parts = [d.where(c).withColumn("part", F.lit(p)) for p, c in
             (("train", "day_index < 20"), ("validation", "day_index between 20 and 22"), ("test", "day_index > 22"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
