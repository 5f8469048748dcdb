"""Data and leakage audits; several inputs carry planted faults so that checks must fire."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import audit as A
from diurna.operators import splits as S
from diurna.operators import subject as U
from diurna.operators.ranking import one_row
from diurna.plans.q_01_sources import print_sql
from diurna.plans.registry import query
from diurna.sources import files

LOG = {"s": "check_name detail severity", "i": "passed"}


def rows(*items) -> str:
    """UNION ALL of (check, violation count SQL, pass condition, severity)."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST(v AS VARCHAR) AS detail, '{sev}' AS severity, {cond} AS passed FROM (SELECT ({sql}) AS v)" for n, sql, cond, sev in items)


@query("audit_dataset", **LOG, sql="WITH e AS (SELECT e.*, s.y FROM c_ep e JOIN c_subj s ON s.subject_id = e.subject_id) " + rows(
    ("one_row_per_subject_day", "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY subject_id, date HAVING count(*) > 1)", "v = 0", "critical"),
    ("unique_row_id", "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY ep_id HAVING count(*) > 1)", "v = 0", "critical"),
    ("label_constant", "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY subject_id HAVING min(y) <> max(y))", "v = 0", "critical"),
    ("finite_features", "SELECT count(*) FROM e WHERE value IS NULL OR NOT isfinite(value)", "v = 0", "warning"),
    ("expected_columns", "SELECT 1", "v = 2", "critical")))
def _(t):
    d = t.episodes.join(t.subjects.select("subject_id", "y"), "subject_id")
    return A.dataset(d, "subject_id", "date", "ep_id", "y", ["value"], 2)


def inter(cols: str) -> str:
    return f"SELECT count(*) FROM (SELECT DISTINCT {cols} FROM tr INTERSECT SELECT DISTINCT {cols} FROM te)"


@query("audit_split", **LOG, sql="WITH tr AS (SELECT * FROM c_ep WHERE ep_id % 5 <> 0), te AS (SELECT * FROM c_ep WHERE ep_id % 5 = 0), mk AS (SELECT ep_id - 1 AS source_id FROM tr WHERE ep_id % 7 = 1) " + rows(
    ("subject_overlap", inter("subject_id"), "v = 0", "critical"), ("row_overlap", inter("ep_id"), "v = 0", "critical"), ("subject_date_overlap", inter("subject_id, date"), "v = 0", "critical"),
    ("fit_scope_excludes_test", inter("subject_id"), "v = 0", "critical"),
    ("sampling_scope_excludes_test", "SELECT count(DISTINCT subject_id) FROM tr WHERE value > 480 AND subject_id IN (SELECT subject_id FROM te)", "v = 0", "critical"),
    ("provenance_complete", "SELECT count(*) FROM mk WHERE source_id NOT IN (SELECT ep_id FROM c_ep)", "v = 0", "critical"),
    ("provenance_excludes_test", "SELECT count(*) FROM mk WHERE source_id IN (SELECT ep_id FROM te)", "v = 0", "critical")))
def _(t):
    tr, te = t.episodes.where("ep_id % 5 <> 0"), t.episodes.where("ep_id % 5 = 0")
    return A.split(tr, te, "subject_id", "ep_id", "date", tr, tr.where("value > 480"), tr.where("ep_id % 7 = 1").select((F.col("ep_id") - 1).alias("source_id")))


@query("audit_temporal_order", **LOG, sql="""WITH z AS (SELECT a.subject_id, a, b FROM (SELECT subject_id, max(date) AS a FROM c_slp WHERE day(date) <= 20 GROUP BY 1) a JOIN (SELECT subject_id, min(date) AS b FROM c_slp WHERE day(date) >= 24 GROUP BY 1) b ON a.subject_id = b.subject_id) """ + rows(
    ("train_before_test", "SELECT count(*) FROM z WHERE a >= b", "v = 0", "critical"), ("embargo", "SELECT min(b - a - 1) FROM z", "v >= 3", "critical")))
def _(t):
    d = F.dayofmonth("date")
    return A.temporal_order(t.sleep.where(d <= 20), t.sleep.where(d >= 24), "subject_id", "date", 3)


@query("audit_outer_isolation", i="outer_fold n_test leaked passed", sql="""
    SELECT fold AS outer_fold, count(*) AS n_test, count(*) FILTER (WHERE fold = 2 AND CAST(subject_id AS BIGINT) % 50 = 0) AS leaked, count(*) FILTER (WHERE fold = 2 AND CAST(subject_id AS BIGINT) % 50 = 0) = 0 AS passed FROM c_cust GROUP BY 1""")
def _(t):
    c = t.customers.select("subject_id", "y", "fold")
    inner = S.inner_folds(c, "subject_id", "y", "fold", 5, 4, 11).select("outer_fold", "subject_id")
    outer = c.select(F.col("fold").alias("outer_fold"), "subject_id")
    planted = outer.where("outer_fold = 2 and subject_id % 50 = 0")
    return A.outer_isolation(inner.unionByName(planted), outer, "subject_id")


@query("duplicate_windows_across_split", s="subject_id wk", sql="""
    WITH w AS (SELECT subject_id, wk, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS x FROM c_rec GROUP BY 1, 2),
    p AS (SELECT * FROM w UNION ALL SELECT CAST(CAST(subject_id AS BIGINT) * 5 AS VARCHAR), 'planted ' || wk, x FROM w WHERE CAST(subject_id AS BIGINT) % 5 = 1
      UNION ALL SELECT CAST(CAST(subject_id AS BIGINT) * 5 AS VARCHAR), 'tail ' || wk, x || ',9' FROM w WHERE CAST(subject_id AS BIGINT) % 5 = 1)
    SELECT subject_id, wk FROM p WHERE CAST(subject_id AS BIGINT) % 5 = 0 AND x IN (SELECT x FROM p WHERE CAST(subject_id AS BIGINT) % 5 <> 0)""")
def _(t):
    """Planted: copies of train windows under test subjects, and copies that differ in the last code only."""
    d = t.recordings.select("subject_id", "wk", F.col("codes").alias("x"))
    test = F.col("subject_id").cast("bigint") % 5 == 0
    source = d.where(F.col("subject_id").cast("bigint") % 5 == 1).withColumn("subject_id", (F.col("subject_id").cast("bigint") * 5).cast("string"))
    same = source.withColumn("wk", F.concat(F.lit("planted "), "wk"))
    other = source.withColumns({"wk": F.concat(F.lit("tail "), "wk"), "x": F.array_append("x", F.lit(9))})
    d = d.unionByName(same).unionByName(other)
    return A.duplicate_contents(d.where(~test), d.where(test), F.col("x"), ["subject_id", "wk"])


@query("prediction_coverage", s="subject_id model", i="n", sql="SELECT subject_id, model, count(*) AS n FROM c_oof WHERE NOT (seed = 2 AND fold = 3) GROUP BY 1, 2 HAVING count(*) <> 3")
def _(t):
    return A.coverage(t.oof_by_subject.where("not (seed = 2 and fold = 3)"), "subject_id", ["model"], 3)


FROZEN = ("subject_id", "model", "seed", "score")
CHANGED = "CASE WHEN subject_id = (SELECT min(subject_id) FROM c_oof) AND model = 'a' AND seed = 1 THEN score + 0.5 ELSE score END"


@query("frozen_predictions_check", s="kind", i="n1 a1 b1 unchanged", sql=f"""
    WITH a AS ({print_sql("c_oof", *FROZEN)}), b AS ({print_sql(f"(SELECT subject_id, model, seed, {CHANGED} AS score FROM c_oof)", *FROZEN)})
    SELECT 'same' AS kind, a.n_rows AS n1, a.digest_a AS a1, a.digest_b AS b1, (a.digest_a = c.digest_a AND a.digest_b = c.digest_b)::INT AS unchanged FROM a, a AS c
    UNION ALL SELECT 'one score changed', a.n_rows, a.digest_a, a.digest_b, (a.digest_a = b.digest_a AND a.digest_b = b.digest_b)::INT FROM a, b""")
def _(t):
    p = t.oof.select(*FROZEN)
    path = files.scratch(t.spark, "frozen")
    files.write_table(p, path)
    after = t.spark.read.parquet(path).join(t.customers.select("subject_id", "y"), "subject_id", "left")
    first = p.agg(F.min("subject_id").alias("first"))
    hit = (F.col("subject_id") == F.col("first")) & (F.col("model") == "a") & (F.col("seed") == 1)
    changed = after.transform(one_row, first).withColumn("score", F.when(hit, F.col("score") + 0.5).otherwise(F.col("score")))
    return A.frozen(p, after, FROZEN).withColumn("kind", F.lit("same")).unionByName(A.frozen(p, changed, FROZEN).withColumn("kind", F.lit("one score changed")))


@query("identifier_in_features", **LOG, sql="WITH e AS (SELECT e.*, CASE WHEN ep_id % 97 = 0 THEN 9 ELSE s.y END AS y FROM c_ep e JOIN c_subj s ON s.subject_id = e.subject_id) " + rows(
    ("subject_date_duplicates", "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY subject_id, date HAVING count(*) > 1)", "v = 0", "critical"),
    ("label_changes", "SELECT count(*) FROM (SELECT 1 FROM e GROUP BY subject_id HAVING count(DISTINCT y) > 1)", "v = 0", "critical"), ("identifier_as_feature", "SELECT 1", "v = 0", "critical")))
def _(t):
    d = t.episodes.join(t.subjects.select("subject_id", "y"), "subject_id").withColumn("y", F.when(F.col("ep_id") % 97 == 0, 9).otherwise(F.col("y")))
    return A.identifiers(d, "subject_id", "date", "y", ["value", "subject_id"])


@query("subset_rebuild_equal", **LOG, sql="SELECT 'subset_rebuild_equal' AS check_name, '0' AS detail, 'critical' AS severity, 1 AS passed")
def _(t):
    half = F.col("subject_id").cast("bigint") % 2 == 0
    keys = ["subject_id", "channel"]

    def rounded(d):
        return d.select(*keys, *[F.round(c, 9).alias(c) for c in d.columns if c not in keys])

    whole = rounded(U.rich_stats(t.daily_arrays, keys)).where(half)
    alone = rounded(U.rich_stats(t.daily_arrays.where(half), keys))
    return A.same_frames(whole, alone, "subset_rebuild_equal")


@query("privacy_scan", s="artefact", i="ids_found", sql=f"""
    SELECT 'leaky' AS artefact, count(*) AS ids_found FROM c_subj UNION ALL SELECT 'sentence', count(*) FROM c_subj UNION ALL SELECT 'clean', 0""")
def _(t):
    base = files.scratch(t.spark, "artefacts")
    ids = t.subjects.select(F.concat(F.lit("user-"), "subject_id").alias("sid"))
    ids.select(F.concat(F.lit('{"id": "'), "sid", F.lit('"}')).alias("value")).write.text(f"{base}/leaky")
    ids.select(F.concat(F.lit("Seen: mail@"), "sid", F.lit(".")).alias("value")).write.text(f"{base}/sentence")
    ids.select(F.concat(F.lit('{"id": "'), F.sha2("sid", 256), F.lit('"}')).alias("value")).write.text(f"{base}/clean")
    texts = t.spark.read.option("recursiveFileLookup", "true").text(base).withColumn("artefact", F.regexp_extract(F.col("_metadata.file_path"), r"/(leaky|sentence|clean)/", 1))
    return A.privacy(texts, "value", "artefact", ids, "sid")


@query("synthetic_not_in_eval", **LOG, sql=f"""SELECT 'synthetic_not_in_eval' AS check_name, CAST(count(*) AS VARCHAR) AS detail, 'critical' AS severity, count(*) = 0 AS passed FROM c_vec WHERE fold = 0 AND vec_id % 7 = 0""")
def _(t):
    d = t.vectors.withColumns({"is_synthetic": (F.col("vec_id") % 7 == 0).cast("int"), "role": F.when(F.col("fold") == 0, "test").otherwise("train")})
    return A.count_is_zero(d.where("is_synthetic = 1 and role <> 'train'"), "synthetic_not_in_eval")


