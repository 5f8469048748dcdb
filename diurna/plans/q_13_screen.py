"""Feature screening and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import screen as S
from diurna.operators.draws import subsample_steps
from diurna.plans.q_12_splits import weight_sql
from diurna.plans.q_15_metrics import XS, auc_sql
from diurna.plans.registry import query
from diurna.sources.carriers import stack_columns


def f_sql(src: str, by: str = "") -> str:
    k = by + "feature"
    return (f"SELECT {k}, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_value FROM (SELECT *, sum(n * m) OVER (PARTITION BY {k}) / sum(n) OVER (PARTITION BY {k}) AS gm "
            f"FROM (SELECT {k}, y3, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM {src} GROUP BY {k}, y3)) GROUP BY {k}")


@query("anova_f_select", s="feature", i="rank", f="f_value", sql=f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY f_value DESC, feature) AS rank FROM ({f_sql('c_vl')})) WHERE rank <= 4")
def _(t):
    return S.best_k(S.anova_f(t.vector_long, [], "feature", "y3", "value"), [], "feature", "f_value", 4)


VLN = "(SELECT vec_id, y, feature, CASE WHEN feature <> 'x7' OR vec_id % 4 = 0 THEN value END AS value FROM c_vl)"


@query("direction_free_auc_screen", s="feature", f="auc", sql=f"""
    SELECT n.feature, CASE WHEN k >= greatest(8, ceil(0.4 * n)) THEN greatest(auc, 1 - auc) ELSE 0.5 END AS auc FROM (SELECT feature, count(*) AS n, count(value) AS k FROM {VLN} GROUP BY 1) n JOIN ({auc_sql(f'(SELECT * FROM {VLN} WHERE value IS NOT NULL)', 'feature', 'value')}) a ON a.feature = n.feature""")
def _(t):
    d = t.vector_long.withColumn("value", F.when((F.col("feature") != "x7") | (F.col("vec_id") % 4 == 0), F.col("value")))
    return S.direction_free_auc(d, [], "feature", "y", "value")


CORR = """SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM c_vl a JOIN c_vl b ON a.vec_id = b.vec_id
    AND CAST(substr(a.feature, 2) AS INTEGER) < CAST(substr(b.feature, 2) AS INTEGER) GROUP BY 1, 2"""


@query("correlation_prune", s="feature", i="kept", f="f_value", sql=f"""
    WITH r0 AS ({CORR}), rr AS (SELECT a, b, r FROM r0 UNION ALL SELECT b, a, r FROM r0), sc AS ({f_sql('c_vl')}), o AS (SELECT *, row_number() OVER (ORDER BY f_value DESC, feature) AS i FROM sc),
    bad AS (SELECT o.i, list(p.feature) AS clash FROM o JOIN rr ON rr.a = o.feature JOIN o p ON p.feature = rr.b WHERE abs(rr.r) >= 0.1 GROUP BY 1),
    ob AS (SELECT o.i, o.feature, coalesce(bad.clash, []) AS clash FROM o LEFT JOIN bad ON bad.i = o.i),
    g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT ob.i, CASE WHEN list_has_any(g.kept, ob.clash) THEN g.kept ELSE list_append(g.kept, ob.feature) END FROM g JOIN ob ON ob.i = g.i + 1)
    SELECT feature, f_value, list_contains((SELECT kept FROM g WHERE i = (SELECT count(*) FROM sc)), feature) AS kept FROM sc""")
def _(t):
    return S.correlation_prune(t.vectors, XS, S.anova_f(t.vector_long, [], "feature", "y3", "value"), "feature", "f_value", 0.1)


@query("spearman_pairs", s="a b", f="r", sql="""
    WITH k AS (SELECT vec_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS value FROM c_vl)
    SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id AND CAST(substr(a.feature, 2) AS INTEGER) < CAST(substr(b.feature, 2) AS INTEGER) GROUP BY 1, 2""")
def _(t):
    return S.spearman_pairs(t.vector_long, "vec_id", "feature", "value", XS)


SUBSAMPLES = 200


@query("stability_selection", s="feature", i="selected", f="frequency", sql=f"""
    WITH tk AS ({weight_sql(81, SUBSAMPLES, 'c_vec', 'vec_id', subsample_steps(0.632))}), l AS (SELECT tk.draw, v.feature, v.y, v.value FROM c_vl v JOIN tk ON tk.vec_id = v.vec_id),
    a AS ({auc_sql('l', 'draw, feature', 'value')}), ch AS (SELECT feature FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY greatest(auc, 1 - auc) DESC, feature) AS r FROM a) WHERE r <= 3),
    f AS (SELECT x.feature, count(ch.feature) / {SUBSAMPLES}.0::DOUBLE AS frequency FROM (SELECT DISTINCT feature FROM c_vl) x LEFT JOIN ch ON ch.feature = x.feature GROUP BY 1),
    g AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, feature) AS r, count(*) FILTER (WHERE frequency >= 0.6) OVER () AS n FROM f)
    SELECT feature, frequency, CASE WHEN n < 3 THEN r <= 3 ELSE frequency >= 0.6 AND r <= 40 END AS selected FROM g""")
def _(t):
    return S.stability_selection(t.vector_long, "vec_id", "feature", "y", "value", SUBSAMPLES, 3, 81)


def fold_sets(t):
    d = t.vector_long.withColumn("out_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> out_fold")
    return S.best_k(S.anova_f(d, ["out_fold"], "feature", "y3", "value"), ["out_fold"], "feature", "f_value", 4)


SETS = f"SELECT out_fold, feature FROM (SELECT *, row_number() OVER (PARTITION BY out_fold ORDER BY f_value DESC, feature) AS rank FROM ({f_sql('(SELECT * FROM c_vl, (SELECT unnest(range(5)) AS out_fold) WHERE fold <> out_fold)', 'out_fold, ')})) WHERE rank <= 4"


@query("selection_jaccard", s="feature", i="times n_sets n_always", f="frequency mean_jaccard min_jaccard", sql=f"""
    WITH s AS ({SETS}), z AS (SELECT out_fold, list(feature) AS s FROM s GROUP BY 1), j AS (SELECT len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS j FROM z a JOIN z b ON a.out_fold < b.out_fold)
    SELECT feature, times, n_sets, times / n_sets::DOUBLE AS frequency, mean_jaccard, min_jaccard, (SELECT count(*) FROM (SELECT feature FROM s GROUP BY 1 HAVING count(*) = 5)) AS n_always
    FROM (SELECT feature, count(*) AS times FROM s GROUP BY 1), (SELECT avg(j) AS mean_jaccard, min(j) AS min_jaccard FROM j), (SELECT count(*) AS n_sets FROM z)""")
def _(t):
    return S.jaccard(fold_sets(t), "out_fold", "feature")


NEAR = {"near_copy": "x1 * 2 + x2 * 0.01", "constant": "1.0"}


@query("redundancy_report", i="n_pairs n_columns", sql=f"""
    WITH l AS (SELECT vec_id, unnest([{', '.join(f"'{c}'" for c in [*XS, *NEAR])}]) AS f, unnest([{', '.join(f'({e})::DOUBLE' for e in [*XS, *NEAR.values()])}]) AS v FROM c_vn),
    m AS (SELECT f, median(v) AS med FROM l GROUP BY f HAVING count(v) >= 2 AND stddev_pop(v) > 1e-10), z AS (SELECT vec_id, l.f, coalesce(v, med) AS v FROM l JOIN m ON m.f = l.f),
    p AS (SELECT corr(a.v, b.v) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.f < b.f GROUP BY a.f, b.f)
    SELECT count(*) FILTER (WHERE abs(r) >= 0.95) AS n_pairs, (SELECT count(*) FROM m) AS n_columns FROM p""")
def _(t):
    d = t.vectors_missing.select(*XS, *[F.expr(e).cast("double").alias(c) for c, e in NEAR.items()])
    return S.redundancy(d, d.columns)


def effect_sql(src: str, label: str = "y3") -> str:
    return f"""WITH d AS (SELECT feature, {label} AS g, value FROM {src} WHERE value IS NOT NULL),
    q AS (SELECT feature, g, count(*) AS n, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value) AS sd FROM d GROUP BY 1, 2),
    md AS (SELECT d.feature, d.g, median(abs(value - med)) * 1.4826::DOUBLE AS mad FROM d JOIN q ON q.feature = d.feature AND q.g = d.g GROUP BY 1, 2),
    s AS (SELECT q.*, CASE WHEN n < 2 THEN NULL WHEN iqr / 1.349::DOUBLE > 1e-12 THEN iqr / 1.349::DOUBLE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd END AS sc FROM q JOIN md ON md.feature = q.feature AND md.g = q.g),
    j AS (SELECT s.*, r.med AS rm, sqrt((coalesce(s.sc * s.sc, 0) + coalesce(r.sc * r.sc, 0)) / nullif((s.sc IS NOT NULL)::INT + (r.sc IS NOT NULL)::INT, 0)) AS pl FROM s LEFT JOIN s r ON r.feature = s.feature AND r.g = 0),
    cd AS (SELECT a.feature, a.g, avg(sign(a.value - b.value)) AS delta FROM d a JOIN d b ON a.feature = b.feature AND b.g = 0 AND a.g <> 0 GROUP BY 1, 2)
    SELECT j.feature, j.g AS y3, n, med AS median, iqr, med - rm AS median_diff, CASE WHEN pl > 1e-12 THEN (med - rm) / pl END AS robust_smd, CASE WHEN j.g = 0 THEN 0 ELSE delta END AS cliffs_delta FROM j LEFT JOIN cd ON cd.feature = j.feature AND cd.g = j.g"""


@query("univariate_effect_table", s="feature", i="y3 n", f="median iqr median_diff robust_smd cliffs_delta", sql=effect_sql("c_vl"))
def _(t):
    return S.effects(t.vector_long, "feature", "y3", "value")


COVER = "(SELECT feature, y3, value FROM (SELECT s.y3, unnest(['days', 'events', 'peak']) AS feature, unnest([days::DOUBLE, ev::DOUBLE, pk]) AS value FROM (SELECT subject_id, count(*) AS days, sum(n) AS ev, max(v_max) AS pk FROM c_day GROUP BY 1) d JOIN c_subj s ON s.subject_id = d.subject_id))"


@query("negative_control_summary", i="n_moderate n_strong", f="max_abs_delta", sql=f"""
    SELECT count(DISTINCT feature) FILTER (WHERE abs(cliffs_delta) >= 0.33) AS n_moderate, count(DISTINCT feature) FILTER (WHERE abs(cliffs_delta) >= 0.474) AS n_strong, max(abs(cliffs_delta)) AS max_abs_delta FROM ({effect_sql(COVER)}) WHERE y3 <> 0""")
def _(t):
    g = t.daily.groupBy("subject_id").agg(F.count("*").alias("days"), F.sum("n").alias("events"), F.max("v_max").alias("peak")).join(t.subjects.select("subject_id", "y3"), "subject_id")
    e = S.effects(stack_columns(g, ["y3"], ["days", "events", "peak"], "feature"), "feature", "y3", "value")
    return S.negative_controls(e, "feature", "y3")
