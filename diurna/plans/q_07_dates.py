"""Date, clock and circular-time functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from diurna.functions import clock as C
from diurna.operators.joins import join_modalities
from diurna.plans.registry import query

ISO_SQL = """SELECT event_id, ts, CASE WHEN event_id % 10 = 7 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN event_id % 3 = 0 THEN '+00:00' ELSE '+09:00' END END AS iso FROM events"""
CLOCK = "(hour({0}) + minute({0}) / 60.0::DOUBLE + second({0}) / 3600.0::DOUBLE)"


def iso(t):
    k = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 3 == 0, "+00:00").otherwise("+09:00"))
    return t.events.select("event_id", "ts", F.when(k % 10 == 7, "not a time").otherwise(text).alias("iso"))


@query("to_local_time", s="local", i="event_id", sql=f"""
    SELECT event_id, CASE WHEN event_id % 10 <> 7 THEN strftime(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 9 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') END AS local FROM ({ISO_SQL})""")
def _(t):
    return iso(t).select("event_id", C.local_time(F.col("iso")).alias("local"))


@query("to_naive_local", s="local", i="event_id", sql=f"""
    SELECT event_id, CASE WHEN event_id % 10 <> 7 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS local FROM ({ISO_SQL})""")
def _(t):
    return iso(t).select("event_id", C.naive_local(F.col("iso")).alias("local"))


@query("day_boundary_shift", s="day", i="event_id", sql="SELECT event_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS day FROM events")
def _(t):
    return t.events.select("event_id", C.shifted_day(F.col("ts"), 4).alias("day"))


@query("clock_hours", i="event_id", f="h", sql=f"SELECT event_id, {CLOCK.format('ts')} AS h FROM events")
def _(t):
    return t.events.select("event_id", C.clock_hour(F.col("ts")).alias("h"))


@query("bedtime_continuous", i="ep_id", f="h", sql=f"SELECT ep_id, CASE WHEN h < 12 THEN h + 24 ELSE h END AS h FROM (SELECT ep_id, {CLOCK.format('start_ts')} AS h FROM c_ep)")
def _(t):
    return t.episodes.select("ep_id", C.unwrap_bedtime(C.clock_hour(F.col("start_ts"))).alias("h"))


@query("circular_midpoint", i="ep_id", f="mid", sql=f"""
    SELECT ep_id, (s + ((e - s + 24) % 24) / 2) % 24 AS mid FROM (SELECT ep_id, {CLOCK.format('start_ts')} AS s, {CLOCK.format('end_ts')} AS e FROM c_ep)""")
def _(t):
    return t.episodes.select("ep_id", C.circular_midpoint(C.clock_hour(F.col("start_ts")), C.clock_hour(F.col("end_ts"))).alias("mid"))


@query("cyclic_encode", i="event_id", f="sin_h cos_h", sql=f"SELECT event_id, sin(2 * pi() * {CLOCK.format('ts')} / 24) AS sin_h, cos(2 * pi() * {CLOCK.format('ts')} / 24) AS cos_h FROM events")
def _(t):
    h = C.clock_hour(F.col("ts"))
    return t.events.select("event_id", C.hour_sin(h).alias("sin_h"), C.hour_cos(h).alias("cos_h"))


@query("time_bin_onehot", i="event_id bin_0 bin_1 bin_2 bin_3 bin_4 bin_5", sql="SELECT event_id, " + ", ".join(f"hour(ts) // 4 = {k} AS bin_{k}" for k in range(6)) + " FROM events")
def _(t):
    return t.events.select("event_id", *C.four_hour_bins(F.hour("ts")))


@query("duration_hours_bounded", s="subject_id date", f="h", sql="""
    SELECT a.subject_id, a.date, CASE WHEN d BETWEEN 0 AND 48 THEN d END AS h FROM (SELECT a.subject_id, a.date, (epoch_us(slp_start) - epoch_us(act_end)) / 3.6e9::DOUBLE AS d
      FROM c_act a JOIN c_slp s ON a.subject_id = s.subject_id AND a.date = s.date) a""")
def _(t):
    d = join_modalities(t.activity, t.sleep)
    return d.select("subject_id", "date", C.bounded_hours(F.col("act_end"), F.col("slp_start")).alias("h"))


@query("relative_day_index", s="subject_id date", i="day_index dow is_weekend", sql="SELECT subject_id, date, day_index, dow, is_weekend FROM c_day")
def _(t):
    first = F.min("date").over(Window.partitionBy("subject_id"))
    return t.daily.select("subject_id", "date", F.datediff("date", first).alias("day_index"), F.weekday("date").alias("dow"),
                          (F.weekday("date") >= 5).alias("is_weekend"))


@query("literal_clock_difference", i="ep_id", f="diff", sql=f"SELECT ep_id, {CLOCK.format('end_ts')} - {CLOCK.format('start_ts')} AS diff FROM c_ep")
def _(t):
    return t.episodes.select("ep_id", (C.clock_hour(F.col("end_ts")) - C.clock_hour(F.col("start_ts"))).alias("diff"))
