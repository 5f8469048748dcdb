"""Lifelog-shaped views over the test tables.

The minute grid keeps at most 1440 rows per subject-day however many raw events a
subject has, because the first step is a map-side combined aggregation.  Everything
downstream (recordings, daily channels, subject arrays) is bounded by the calendar.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions.hashing import hash_int

CHANNELS = ("v_max", "click_v", "purchase_v")
PER_TASK = 50_000  # subjects that one task groups
DIM = 64  # width of the vectors in the table
FEATURES = tuple(f"x{k}" for k in range(1, DIM + 1))


def stack_columns(df: DataFrame, keep, columns, name="channel", value="value") -> DataFrame:
    """Wide to long without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(pairs))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("subject_id"), F.to_date("ts").alias("date"),
            "ts", "event_id", "event_type", "value", "user_id")

    @cached_property
    def minutes(self) -> DataFrame:
        code = (F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
                .when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 4).otherwise(5))
        return (
            self.events.withColumn("minute", (F.hour("ts") * 60 + F.minute("ts")).cast("int"))
            .groupBy("subject_id", "date", "minute")
            .agg(F.max("value").alias("value"), F.min(code).alias("code"))
            .withColumn("value", F.when(F.col("minute") % 11 != 0, F.col("value")))
        )

    def _arrays(self, df: DataFrame, *keys) -> DataFrame:
        return (
            df.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("date", "minute", "value", "code"))).alias("r"))
            .select(*keys, F.col("r.date").alias("dates"), F.col("r.minute").alias("mins"),
                    F.col("r.value").alias("vals"), F.col("r.code").alias("codes"))
        )

    @cached_property
    def recordings(self) -> DataFrame:
        """One row per subject-week: arrays of at most 10080 minutes."""
        wk = F.date_trunc("week", "date").cast("date").cast("string")
        return self._arrays(self.minutes.withColumn("wk", wk), "subject_id", "wk")

    @cached_property
    def day_arrays(self) -> DataFrame:
        return self._arrays(self.minutes, "subject_id", "date")

    @cached_property
    def raw_days(self) -> DataFrame:
        """Slash-separated cells with placeholder and bad tokens, as in the raw exports."""
        token = F.when(F.col("minute") % 11 == 0, "...").when(F.col("minute") % 13 == 0, "x1").otherwise(
            F.col("value").cast("string"))
        return (
            self.minutes.withColumn("tok", token).groupBy("subject_id", "date")
            .agg(F.sort_array(F.collect_list(F.struct("minute", "tok", "code"))).alias("r"))
            .select("subject_id", "date",
                    F.concat(F.concat_ws("/", "r.tok"), F.lit("/")).alias("txt"),
                    F.concat_ws("/", F.col("r.code").cast("array<string>")).alias("codes_txt"))
        )

    def _daily(self, types=None, prefix="", extra=()) -> DataFrame:
        ev = self.events if types is None else self.events.where(F.col("event_type").isin(*types))
        return ev.groupBy("subject_id", "date").agg(
            F.count("*").alias(prefix + "n"), F.avg("value").alias(prefix + "mean"), F.max("value").alias(prefix + "max"),
            F.min("ts").alias(prefix + "start"), F.max("ts").alias(prefix + "end"), *extra)

    @cached_property
    def activity(self) -> DataFrame:
        return self._daily(("click", "view", "error"), "act_")

    @cached_property
    def sleep(self) -> DataFrame:
        return self._daily(("signup", "purchase"), "slp_")

    @cached_property
    def episodes(self) -> DataFrame:
        """Several sleep-like episodes per subject-day."""
        dur = F.round(F.col("value") * 100).cast("bigint")
        return self.events.where(F.col("event_type").isin("signup", "purchase")).select(
            "subject_id", "date", F.col("event_id").alias("ep_id"), F.col("ts").alias("start_ts"),
            (F.col("ts") + F.make_dt_interval(secs=dur.cast("decimal(18,6)"))).alias("end_ts"),
            dur.alias("dur_s"), "value")

    @cached_property
    def daily(self) -> DataFrame:
        from pyspark.sql import Window

        types = ("click", "view", "error", "signup", "purchase")
        extra = [F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(f"{t}_v") for t in types]
        d = self._daily(None, "", extra).withColumnsRenamed(
            {"mean": "v_mean", "max": "v_max", "start": "first_ts", "end": "last_ts"})
        w = Window.partitionBy("subject_id")
        return d.withColumns({
            "day_index": F.datediff("date", F.min("date").over(w)),
            "dow": F.weekday("date"), "is_weekend": (F.weekday("date") >= 5).cast("int")})

    @cached_property
    def long(self) -> DataFrame:
        return stack_columns(self.daily, ["subject_id", "date", "day_index", "is_weekend"], CHANNELS)

    @cached_property
    def daily_arrays(self) -> DataFrame:
        """One row per subject and channel: values in day order (one per calendar day seen)."""
        return (
            self.daily.groupBy("subject_id")
            .agg(F.sort_array(F.collect_list(F.struct("day_index", "is_weekend", *CHANNELS))).alias("r"))
            .select("subject_id", F.col("r.day_index").alias("days"), F.col("r.is_weekend").alias("wend"),
                    F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"r.{c}").alias("vals"))
                                       for c in CHANNELS])))
        )

    @cached_property
    def subjects(self) -> DataFrame:
        m = F.col("user_id") % 3
        return self.events.select(
            "subject_id", m.cast("int").alias("y3"), (m > 0).cast("int").alias("y"),
            F.when(m == 0, "CN").when(m == 1, "MCI").otherwise("Dem").alias("diag")).distinct()

    @cached_property
    def hourly(self) -> DataFrame:
        return self.events.groupBy("subject_id", F.hour("ts").alias("hour")).agg(F.avg("value").alias("value"))

    @cached_property
    def hour_profiles(self) -> DataFrame:
        """24-slot hourly profile per subject; hours without data are NULL."""
        slots = F.map_from_entries(F.collect_list(F.struct("hour", "value")))
        return self.hourly.groupBy("subject_id").agg(slots.alias("m")).select(
            "subject_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda x: F.try_element_at("m", x)).alias("profile"))

    @cached_property
    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        y3 = hash_int("y", k) % 3
        return self.table("customer").select(
            k.cast("string").alias("subject_id"), y3.cast("int").alias("y3"), (y3 > 0).cast("int").alias("y"),
            (hash_int("f", k) % 5).cast("int").alias("fold"))

    @cached_property
    def oof(self) -> DataFrame:
        """Out-of-fold scores: two models, three seeds, with ties."""
        return self._scores(self.customers)

    @cached_property
    def oof_by_subject(self) -> DataFrame:
        """The rows of ``oof`` for groupings by subject: dealt by subject, at most about PER_TASK subjects in a task.

        A table file is often one task; without this its hash tables hold every subject.
        """
        n = -(-max(1, self.table("customer").count()) // PER_TASK)
        return self._scores(self.customers.repartition(n, "subject_id"))

    def _scores(self, customers: DataFrame) -> DataFrame:
        seeds = F.explode(F.array(*[F.lit(i) for i in range(3)]))
        models = F.explode(F.array(F.lit("a"), F.lit("b")))
        df = customers.withColumn("seed", seeds).withColumn("model", models)
        a = hash_int("a", F.col("seed"), F.col("subject_id")) % 700 + 100 * F.col("y3")
        b = hash_int("b", F.col("seed"), F.col("subject_id")) % 800 + 60 * F.col("y3")
        return df.withColumn("score", F.when(F.col("model") == "a", a).otherwise(b) / F.lit(1000.0))

    @cached_property
    def probabilities(self) -> DataFrame:
        sid = F.col("subject_id")
        raw = [(hash_int(f"p{k}", sid) % 100 + 1 + F.when(F.col("y3") == k, 80).otherwise(0)).cast("double") for k in range(3)]
        df = self.customers.withColumns({f"q{k}": raw[k] for k in range(3)})
        tot = F.col("q0") + F.col("q1") + F.col("q2")
        return df.select("subject_id", "y3", "fold", *[(F.col(f"q{k}") / tot).alias(f"p{k}") for k in range(3)])

    @cached_property
    def order_scores(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderkey").alias("window_id"),
            F.to_date("o_orderdate").alias("date"), (hash_int("y", F.col("o_custkey")) % 3 > 0).cast("int").alias("y"),
            (F.col("o_totalprice") / F.lit(1000000.0)).alias("score"))

    @cached_property
    def vectors(self) -> DataFrame:
        lab = F.col("label")
        return self.table("embeddings").select(
            "vec_id", lab.cast("int").alias("label"), (lab >= 5).cast("int").alias("y"), (lab % 3).cast("int").alias("y3"),
            (F.col("vec_id") % 5).cast("int").alias("fold"),
            *[F.col("embedding")[k - 1].cast("double").alias(f"x{k}") for k in range(1, DIM + 1)])

    @cached_property
    def vectors_missing(self) -> DataFrame:
        return self.vectors.withColumns({f"x{k}": F.when(F.col("vec_id") % (DIM + 1) != k, F.col(f"x{k}")) for k in range(1, DIM + 1)})

    @cached_property
    def vector_long(self) -> DataFrame:
        return stack_columns(self.vectors, ["vec_id", "label", "y", "y3", "fold"], FEATURES, "feature")

    @cached_property
    def contributions(self) -> DataFrame:
        j = F.substring("feature", 2, 2).cast("int")
        sign = F.when(j % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        return self.vector_long.select("vec_id", "y", "fold", "feature", "value",
                                       (F.col("value") * j * sign).alias("contribution"))


def struct_xy(x: str, y: str) -> Column:
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
