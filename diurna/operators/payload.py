"""Nested JSON payloads, response validation and declarative feature programs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.numbers import clip
from diurna.operators.dedup import evenly_spaced, largest_changes
from diurna.operators.subject import payload_stats


def subject_payload(daily: DataFrame, arrays: DataFrame, long: DataFrame, salt: str, samples: int = 12, changes: int = 3) -> DataFrame:
    """One nested document per subject: observation, statistics, weekly means, samples and changes.

    Every part is grouped on the subject first; lists are bounded by days or by the limits given.
    """
    w = Window.partitionBy("subject_id").orderBy("day_index")
    obs = daily.withColumn("_gap", F.col("day_index") - F.lag("day_index").over(w)).groupBy("subject_id").agg(F.struct(
        F.count("*").alias("n_days"), (F.max("day_index") + 1).alias("window_span_days"),
        F.bround(F.count("*") / (F.max("day_index") + 1), 4).alias("coverage_ratio"), F.sum("is_weekend").alias("weekend_days"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap_days")).alias("observation"))
    stats = payload_stats(arrays, ["subject_id", "channel"])
    stat_cols = [c for c in stats.columns if c not in ("subject_id", "channel")]

    def by_channel(df, value, name):
        entry = F.struct("channel", value)
        return df.groupBy("subject_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name))

    statistics = by_channel(stats, F.struct(*stat_cols).alias("v"), "statistics")
    week = long.groupBy("subject_id", "channel", F.floor(F.col("day_index") / 7).alias("week")).agg(F.bround(F.avg("value"), 4).alias("mean"))
    week = week.groupBy("subject_id", "channel").agg(F.sort_array(F.collect_list(F.struct("week", "mean"))).alias("v"))
    picked = evenly_spaced(daily, "subject_id", "day_index", samples).groupBy("subject_id").agg(
        F.sort_array(F.collect_list(F.struct("day_index", "is_weekend", F.bround("v_max", 4).alias("v_max")))).alias("samples"))
    jumps = largest_changes(long, changes).groupBy("subject_id", "channel").agg(
        F.sort_array(F.collect_list(F.struct("day_index", F.bround("change", 4).alias("change")))).alias("v"))
    parts = [obs, statistics, by_channel(week, F.col("v"), "weekly"), picked, by_channel(jumps, F.col("v"), "changes")]
    doc = reduce(lambda a, b: a.join(b, "subject_id", "left"), parts)
    ref = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "subject_id"), 256), 1, 16)
    return doc.select("subject_id", F.to_json(F.struct(
        F.lit(1).alias("payload_version"), ref.alias("subject_ref"), "observation", "statistics", "weekly", "samples", "changes")).alias("payload"))


def canonical_json(df: DataFrame, keys, name: str, value: str) -> DataFrame:
    """Key-sorted compact JSON object per group, its SHA-256 and byte size."""
    g = df.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value))))).alias("json"))
    return g.withColumns({"sha256": F.sha2("json", 256), "bytes": F.octet_length("json")})


def validate_object(text: Column, fields: dict[str, tuple[float, float]]) -> Column:
    """'ok' or the first broken rule: parse, keys, type, range."""
    keys = F.array_sort(F.json_object_keys(text))
    raw = F.from_json(text, "map<string,string>")
    number = {k: F.try_element_at(raw, F.lit(k)).try_cast("double") for k in fields}
    typed = reduce(lambda a, b: a & b, [n.isNotNull() for n in number.values()])
    ranged = reduce(lambda a, b: a & b, [number[k].between(lo, hi) for k, (lo, hi) in fields.items()])
    want = F.array(*[F.lit(k) for k in sorted(fields)])
    return F.when(keys.isNull(), "parse").when(keys != want, "keys").when(~typed, "type").when(~ranged, "range").otherwise("ok")


def text_entries(df: DataFrame, keep, struct_cols) -> DataFrame:
    """(path, text) rows for every key and value of the given columns."""
    items = [F.struct(F.concat(F.lit("$."), F.lit(c)).alias("path"), F.lit(c).alias("text")) for c in struct_cols]
    items += [F.struct(F.concat(F.lit("$."), F.lit(c), F.lit("/value")).alias("path"), F.col(c).cast("string").alias("text")) for c in struct_cols]
    return df.select(*keep, F.inline(F.array(*items)))


def forbidden_hits(entries: DataFrame, text: str, terms, pattern: str | None = None) -> DataFrame:
    """Terms (whole lower-case words) and pattern found in each text; the whole text is read."""
    words = F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+"))
    hits = F.array_sort(F.array_intersect(words, F.array(*[F.lit(x) for x in terms])))
    d = entries.withColumns({"hits": F.concat_ws(",", hits), "matched": F.col(text).rlike(pattern).cast("int") if pattern else F.lit(0)})
    return d.where((F.col("hits") != "") | (F.col("matched") == 1))


def compile_program(program_json: str, allowed) -> dict[str, Column]:
    """Declarative program (name, operation, dependencies, directions) to bounded Column expressions."""
    out: dict[str, Column] = {}
    for f in json.loads(program_json)["features"]:
        deps, dirs = f["dependencies"], f["directions"]
        unknown = [d for d in deps if d not in allowed]
        if unknown or len(deps) != len(dirs) or any(d not in (-1, 1) for d in dirs) or f["name"] in out:
            raise ValueError(f"invalid feature {f['name']}")
        z = [clip(F.col(d), F.lit(-5.0), F.lit(5.0)) * s for d, s in zip(deps, dirs)]
        if f["operation"] == "signed_mean":
            e = F.tanh(reduce(lambda a, b: a + b, z) / len(z))
        elif f["operation"] == "signed_product":
            e = reduce(lambda a, b: a * b, [F.tanh(x) for x in z])
        elif f["operation"] == "absolute_gap":
            e = F.tanh(F.greatest(*z) - F.least(*z))
        else:
            raise ValueError(f"unknown operation {f['operation']}")
        out[f["name"]] = clip(e, F.lit(-1.0), F.lit(1.0))
    return dict(sorted(out.items()))
