"""JSON documents, text guards and feature programs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from diurna.operators import payload as Y
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

PROGRAM = json.dumps({"program_version": 1, "features": [
    {"name": "fp_mean", "operation": "signed_mean", "dependencies": ["x1", "x2", "x3"], "directions": [1, -1, 1]},
    {"name": "fp_product", "operation": "signed_product", "dependencies": ["x4", "x5"], "directions": [1, -1]},
    {"name": "fp_gap", "operation": "absolute_gap", "dependencies": ["x6", "x7", "x8"], "directions": [1, 1, -1]}]})


@query("subject_payload_json", s="subject_id payload", i="bytes")
def _(t):
    return Y.subject_payload(t.daily, t.daily_arrays, t.long, "pepper").withColumn("bytes", F.octet_length("payload"))


@query("canonical_json_hash", s="subject_id json sha256", i="bytes", sql="""
    SELECT subject_id, j AS json, sha256(j) AS sha256, strlen(j) AS bytes FROM (SELECT subject_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS j
      FROM (SELECT CAST(user_id AS VARCHAR) AS subject_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)""")
def _(t):
    return Y.canonical_json(t.events.groupBy("subject_id", "event_type").agg(F.count("*").alias("n")), ["subject_id"], "event_type", "n")


@query("validate_json_features", s="status", i="event_id", sql="""
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'parse' WHEN event_id % 9 = 1 THEN 'keys' WHEN event_id % 9 = 2 THEN 'type'
      WHEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) NOT BETWEEN 10 AND 80 THEN 'range' ELSE 'ok' END AS status FROM events""")
def _(t):
    k = F.col("event_id") % 9
    text = F.when(k == 0, "{oops").when(k == 1, F.regexp_replace("props", '"k"', '"extra": 1, "k"')).when(k == 2, '{"k": "high"}').otherwise(F.col("props"))
    d = t.table("events").select("event_id", text.alias("doc"))
    return d.select("event_id", Y.validate_object(F.col("doc"), {"k": (10, 80)}).alias("status"))


@query("scan_text_for_forbidden", s="path hits", i="conv_id turn matched", sql="""
    WITH w AS (SELECT conv_id, turn, '$.text/value' AS path, text, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS ws FROM conversations
      UNION ALL SELECT conv_id, turn, '$.role/value', role, [lower(role)] FROM conversations UNION ALL SELECT conv_id, turn, '$.role', 'role', ['role'] FROM conversations UNION ALL SELECT conv_id, turn, '$.text', 'text', ['text'] FROM conversations),
    x AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(ws, lambda z: z IN ('the', 'und', 'que', 'user')))), ',') AS hits, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS m FROM w)
    SELECT conv_id, turn, path, hits, m AS matched FROM x WHERE hits <> '' OR m""")
def _(t):
    e = Y.text_entries(t.table("conversations"), ["conv_id", "turn"], ["role", "text"])
    return Y.forbidden_hits(e, "text", ["the", "und", "que", "user"], "[A-Za-z0-9._]+@[A-Za-z0-9.]+")


def z(c, s):
    return f"(greatest(least({c} * 8, 5), -5) * {s})"


@query("apply_feature_program", i="vec_id", f="fp_mean fp_product fp_gap", sql=f"""
    SELECT vec_id, tanh(({z('x1', 1)} + {z('x2', -1)} + {z('x3', 1)}) / 3) AS fp_mean, tanh({z('x4', 1)}) * tanh({z('x5', -1)}) AS fp_product,
      tanh(greatest({z('x6', 1)}, {z('x7', 1)}, {z('x8', -1)}) - least({z('x6', 1)}, {z('x7', 1)}, {z('x8', -1)})) AS fp_gap FROM c_vec""")
def _(t):
    xs = list(FEATURES)
    d = t.vectors.select("vec_id", *[(F.col(c) * 8).alias(c) for c in xs])
    return d.select("vec_id", *[e.alias(k) for k, e in Y.compile_program(PROGRAM, xs).items()])
