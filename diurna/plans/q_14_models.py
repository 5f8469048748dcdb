"""Learners (rows-only checks) and ensembles (checked against SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import ensemble as E
from diurna.operators import learners as L
from diurna.operators import metrics as M
from diurna.operators import prep as R
from diurna.plans.q_11_prep import CLIPPED, FILL, each, row
from diurna.operators.inference import DRAWS
from diurna.operators.isotonic import isotonic
from diurna.plans.q_12_splits import weight_sql
from diurna.plans.q_13_screen import f_sql
from diurna.plans.q_15_metrics import auc_sql, cells_sql, pts
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

XS = list(FEATURES)
FEW = XS[::16]  # columns of nested_cv's small candidate


def sides(t):
    return t.vectors.where("fold <> 0"), t.vectors.where("fold = 0")


def three(t):
    return t.vectors.withColumn("cv", (F.col("vec_id") % 3).cast("int"))


# ------------------------------------------------------------------ learners
@query("fit_logistic", s="kind", i="vec_id", f="score p0 p1 p2")
def _(t):
    tr, te = sides(t)
    b = L.fit_score("elastic", L.balanced(tr, "y"), te, XS, "y", "weight").select(F.lit("binary").alias("kind"), "vec_id", "score", *[F.lit(None).cast("double").alias(f"p{k}") for k in range(3)])
    m = L.fit_probabilities("logistic", tr, te, XS, "y3", 3).select(F.lit("multinomial").alias("kind"), "vec_id", F.lit(None).cast("double").alias("score"), "p0", "p1", "p2")
    return b.unionByName(m)


@query("fit_tree_ensembles", s="kind", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    out = None
    for k in ("forest", "extra", "boosting"):
        d = L.fit_score(k, tr, te, XS, "y").select(F.lit(k).alias("kind"), "vec_id", "score")
        out = d if out is None else out.unionAll(d)
    return out


@query("fit_linear_svm", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    return L.fit_score("svm", tr, te, XS, "y")


def nb_sql() -> str:
    ll = " ".join(f"- 0.5 * (ln(2 * pi() * (v{c} + eps)) + pow(t.{c} - m{c}, 2) / (v{c} + eps))" for c in XS)
    return f"""WITH m AS (SELECT y3, count(*)::DOUBLE AS n, {each(lambda c: f'avg({c}) AS m{c}, var_pop({c}) AS v{c}')} FROM c_vec WHERE fold <> 0 GROUP BY 1),
      e AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in XS)}) AS eps FROM c_vec WHERE fold <> 0),
      l AS (SELECT vec_id, m.y3 AS k, ln(n / (SELECT sum(n) FROM m)) {ll} AS l FROM c_vec t, m, e WHERE t.fold = 0), s AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS x FROM l)
      SELECT vec_id, max(x) FILTER (WHERE k = 0) / sum(x) AS p0, max(x) FILTER (WHERE k = 1) / sum(x) AS p1, max(x) FILTER (WHERE k = 2) / sum(x) AS p2 FROM s GROUP BY 1"""


BEST = 8


def best_nb_sql() -> str:
    train = "(SELECT * FROM c_vl WHERE fold <> 0)"
    return f"""WITH ff AS ({f_sql(train)}), sel AS (SELECT ff.feature FROM ff JOIN (SELECT feature FROM {train} GROUP BY 1 HAVING var_pop(value) > 1e-10) v ON v.feature = ff.feature ORDER BY f_value DESC, ff.feature LIMIT {BEST}),
      m AS (SELECT feature, y3, avg(value) AS m, var_pop(value) AS v FROM {train} WHERE feature IN (SELECT feature FROM sel) GROUP BY 1, 2),
      e AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(value) AS v FROM {train} WHERE feature IN (SELECT feature FROM sel) GROUP BY feature)),
      pr AS (SELECT y3, ln(count(*) / (SELECT count(*) FROM c_vec WHERE fold <> 0)::DOUBLE) AS lp FROM c_vec WHERE fold <> 0 GROUP BY 1),
      l AS (SELECT t.vec_id, m.y3 AS k, max(lp) - sum(0.5 * (ln(2 * pi() * (v + eps)) + pow(t.value - m, 2) / (v + eps))) AS l FROM c_vl t JOIN m ON m.feature = t.feature JOIN pr ON pr.y3 = m.y3, e WHERE t.fold = 0 GROUP BY 1, 2),
      s AS (SELECT *, exp(l - max(l) OVER (PARTITION BY vec_id)) AS x FROM l)
      SELECT vec_id, max(x) FILTER (WHERE k = 0) / sum(x) AS p0, max(x) FILTER (WHERE k = 1) / sum(x) AS p1, max(x) FILTER (WHERE k = 2) / sum(x) AS p2 FROM s GROUP BY 1"""


@query("fit_naive_bayes", s="variant", i="vec_id", f="p0 p1 p2", sql=f"SELECT 'all' AS variant, * FROM ({nb_sql()}) UNION ALL SELECT 'k_best', * FROM ({best_nb_sql()})")
def _(t):
    tr, te = sides(t)
    every, best = L.gaussian_nb(tr, te, XS, "y3", [0, 1, 2]), L.selected_nb(tr, te, XS, "y3", [0, 1, 2], BEST)
    return every.withColumn("variant", F.lit("all")).unionByName(best.withColumn("variant", F.lit("k_best")))


@query("fit_lda_closed_form", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    return L.lda(tr, te, XS, "y")


@query("fit_mlp", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    return L.mlp(tr, te, XS, "y")


@query("fit_decision_tree", s="kind", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    a = L.fit_score("tree", tr, te, XS, "y").select(F.lit("tree").alias("kind"), "vec_id", "score")
    return a.unionByName(L.knn_vote(tr, te, XS, "vec_id", "y").select(F.lit("knn").alias("kind"), "vec_id", "score"))


@query("unsupervised_features", i="vec_id km gmm tree_label", f="pc_0 pc_1 pc_2 pc_3 pc_4 km_dist_0 km_dist_1 km_dist_2 gmm_p_0 gmm_p_1 gmm_p_2")
def _(t):
    return L.unsupervised(t.vectors, XS)


@query("nested_cv", s="candidate", i="vec_id outer_fold", f="score inner_auc")
def _(t):
    return L.nested_cv(three(t), "y", "cv", [0, 1, 2], {
        "small": {"learner": "logistic", "columns": FEW}, "full": {"learner": "logistic", "columns": XS, "params": {"regParam": 0.1}}})


@query("grid_search", i="best", f="regParam elasticNetParam auc")
def _(t):
    return L.grid_search(three(t), XS, "y", "cv", 3, {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]})


@query("importance_forward_selection", s="feature", i="k best", f="auc")
def _(t):
    return L.forward_path(three(t), XS, "y", "cv", [0, 1, 2])


@query("rfe_order", s="feature", i="rank")
def _(t):
    return L.elimination_order(t.vectors, XS, "y", 3)


@query("leakage_ladder", s="level", f="auc gap")
def _(t):
    return L.leakage_ladder(three(t), XS, "y", "cv", [0, 1, 2], 3, {"weak": {"regParam": 0.01}, "strong": {"regParam": 0.3}})


# The fit by its max-min formula: at each score the largest, over all starts, of the smallest mean up to any end.
@query("isotonic_calibrate", s="model subject_id", i="seed", f="score calibrated", sql="""
    WITH d AS (SELECT model, seed, score, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS s FROM c_oof WHERE fold <> 0 GROUP BY ALL),
    c AS (SELECT *, row_number() OVER k AS i, sum(w) OVER k AS cw, sum(s) OVER k AS cs FROM d WINDOW k AS (PARTITION BY model, seed ORDER BY score)),
    ab AS (SELECT a.model, a.seed, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS v FROM c a JOIN c b ON a.model = b.model AND a.seed = b.seed AND a.i <= b.i),
    mn AS (SELECT model, seed, a, b AS i, min(v) OVER (PARTITION BY model, seed, a ORDER BY b DESC) AS v FROM ab), fit AS (SELECT model, seed, i, max(v) AS v FROM mn GROUP BY ALL),
    p AS (SELECT c.model, c.seed, c.score, v FROM fit JOIN c ON c.model = fit.model AND c.seed = fit.seed AND c.i = fit.i),
    t AS (SELECT model, seed, subject_id, score FROM c_oof WHERE fold = 0),
    q AS (SELECT t.*, lo.score AS xa, lo.v AS va, hi.score AS xb, hi.v AS vb FROM t ASOF LEFT JOIN p lo ON t.model = lo.model AND t.seed = lo.seed AND t.score >= lo.score ASOF LEFT JOIN p hi ON t.model = hi.model AND t.seed = hi.seed AND t.score <= hi.score)
    SELECT model, seed, subject_id, score, CASE WHEN va IS NULL THEN vb WHEN vb IS NULL OR xa = xb THEN va ELSE va + (vb - va) * (score - xa) / (xb - xa) END AS calibrated FROM q""")
def _(t):
    return isotonic(t.oof.where("fold <> 0"), t.oof.where("fold = 0"), "score", "y", ["model", "seed"])


@query("platt_calibrate", s="model subject_id", i="seed", f="score calibrated")
def _(t):
    return L.per_group(L.platt, t.oof.where("fold <> 0"), t.oof.where("fold = 0"), ["model", "seed"], "score", "y")


@query("ordinal_combine", s="strategy", i="vec_id", f="score")
def _(t):
    tr, te = sides(t)
    out = None
    for s in ("binary", "ordinal", "hard_boundary"):
        d = L.ordinal(tr, te, XS, "y3", s).select(F.lit(s).alias("strategy"), "vec_id", "score")
        out = d if out is None else out.unionAll(d)
    return out


@query("linear_contributions", s="feature", i="vec_id", f="z contribution")
def _(t):
    tr, te = sides(t)
    return L.linear_contributions(tr, te, XS, "vec_id", "y")


@query("isolation_outlier", i="vec_id outlier", f="distance", sql="""
    WITH m AS (SELECT feature, median(value) AS med FROM c_vl GROUP BY 1), d AS (SELECT vec_id, v.feature, abs(value - med) AS dev FROM c_vl v JOIN m ON m.feature = v.feature),
    s AS (SELECT feature, median(dev) * 1.4826::DOUBLE AS mad FROM d GROUP BY 1), r AS (SELECT vec_id, sum(pow(dev / nullif(mad, 0), 2)) AS distance FROM d JOIN s ON s.feature = d.feature GROUP BY 1)
    SELECT vec_id, distance, distance > (SELECT quantile_cont(distance, 0.9) FROM r) AS outlier FROM r""")
def _(t):
    """Re-aimed: a tenth of the rows by robust distance instead of grown trees."""
    from diurna.operators.ranking import one_row, quantiles
    from diurna.operators.screen import robust_distance

    s = robust_distance(t.vector_long, "vec_id", "feature", "value")
    cut = quantiles(s, [], "distance", [0.9]).select(F.col("q90").alias("cut"))
    return s.transform(one_row, cut).withColumn("outlier", F.col("distance") > F.col("cut"))


# ------------------------------------------------------------------ ensembles
PCT = "(rank() OVER (PARTITION BY model, seed ORDER BY score) + (count(*) OVER (PARTITION BY model, seed, score) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY model, seed)"


@query("blend_weighted", s="kind subject_id", i="seed", f="blend", sql=f"""
    SELECT 'raw' AS kind, subject_id, seed, sum(score * CASE model WHEN 'a' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) AS blend FROM c_oof GROUP BY 2, 3
    UNION ALL SELECT 'rank', subject_id, seed, sum(s * CASE model WHEN 'a' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END) FROM (SELECT *, {PCT} AS s FROM c_oof) GROUP BY 2, 3""")
def _(t):
    w = {"a": 0.6, "b": 0.4}
    raw = E.blend(t.oof_by_subject, ["subject_id", "seed"], "model", "score", w).withColumn("kind", F.lit("raw"))
    rk = E.rank_scores(t.oof, ["model", "seed"], "score")
    return raw.unionByName(E.blend(rk, ["subject_id", "seed"], "model", "rank_score", w).withColumn("kind", F.lit("rank")))


CAND = E.weight_candidates(["a", "b"], 6, 91, ("b", 0.05))
CV = ", ".join(f"({i}, '{k}', {w['a']!r}::DOUBLE, {w['b']!r}::DOUBLE)" for i, (k, w) in enumerate(CAND))


@query("blend_weight_search", s="candidate", i="seed wid chosen", f="auc concentration", sql=f"""
    WITH w AS (SELECT * FROM (VALUES {CV}) AS v(wid, candidate, wa, wb)), s AS (SELECT seed, subject_id, y, max(score) FILTER (WHERE model = 'a') AS a, max(score) FILTER (WHERE model = 'b') AS b FROM c_oof GROUP BY 1, 2, 3),
    x AS (SELECT seed, wid, candidate, wa * wa + wb * wb AS concentration, y, round(a * wa + b * wb, 9) AS score FROM s, w), r AS ({auc_sql('x', 'seed, wid, candidate, concentration')})
    SELECT seed, wid, candidate, concentration, auc, row_number() OVER (PARTITION BY seed ORDER BY round(auc, 12) DESC, round(concentration, 12), wid) = 1 AS chosen FROM r""")
def _(t):
    return E.weight_search(t.oof_by_subject, ["subject_id"], "model", "score", "y", CAND, ["seed"])


@query("blend_gated", s="model mode", i="seed", f="auc weight", sql=f"""
    WITH a AS ({auc_sql('c_oof', 'model, seed')}), g AS (SELECT *, max((auc >= 0.63)::INT) OVER (PARTITION BY seed) AS anyg, row_number() OVER (PARTITION BY seed ORDER BY auc DESC, model) AS r FROM a),
    w AS (SELECT *, CASE WHEN anyg = 1 THEN CASE WHEN auc >= 0.63 THEN auc - 0.5 ELSE 0 END ELSE (r = 1)::INT END AS raw FROM g)
    SELECT model, seed, auc, CASE WHEN anyg = 1 THEN 'gated_blend' ELSE 'fallback_best' END AS mode, raw / sum(raw) OVER (PARTITION BY seed) AS weight FROM w""")
def _(t):
    return E.gated_weights(M.roc_auc(t.oof, ["model", "seed"], "score", "y"), ["seed"], "model", "auc", 0.63)


WIDE = "(SELECT subject_id, y, y3, seed, max(score) FILTER (WHERE model = 'a') AS d, max(score) FILTER (WHERE model = 'b') AS q FROM c_oof GROUP BY 1, 2, 3, 4)"


def wide(t):
    return t.oof_by_subject.groupBy("subject_id", "y", "y3", "seed").pivot("model", ["a", "b"]).agg(F.max("score")).withColumnsRenamed({"a": "d", "b": "q"})


@query("hierarchical_combine", s="subject_id", i="seed", f="p0 p1 p2", sql=f"""
    SELECT subject_id, seed, (1 - d) * (1 - q) AS p0, (1 - d) * q AS p1, d AS p2 FROM (SELECT subject_id, seed, greatest(least(d, 1 - 1e-9), 1e-9) AS d, greatest(least(q, 1 - 1e-9), 1e-9) AS q FROM {WIDE})""")
def _(t):
    return wide(t).select("subject_id", "seed", *[e.alias(k) for k, e in E.hierarchy(F.col("d"), F.col("q")).items()])


@query("hierarchical_cascade_eval", i="seed y3 predicted n", sql=f"SELECT seed, y3, CASE WHEN d >= 0.6 THEN 2 WHEN q >= 0.45 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM {WIDE} GROUP BY 1, 2, 3")
def _(t):
    return wide(t).groupBy("seed", "y3", E.cascade(F.col("d"), F.col("q"), 0.6, 0.45).alias("predicted")).agg(F.count("*").alias("n"))


SOFT = f"(SELECT subject_id, y, seed, round(0.6::DOUBLE * d + 0.4::DOUBLE * q, 9) AS score FROM {WIDE})"


@query("hard_soft_cascade", s="method", i="seed tp fp tn fn", f="f1 balanced_accuracy", sql=f"""
    WITH p AS ({pts(SOFT, 'seed')}), b AS (SELECT seed, -max({{'j': round(tpr - fpr, 12), 'c': -cut}}).c AS th FROM p WHERE tp + fp > 0 AND tn + fn > 0 GROUP BY 1), s AS (SELECT x.*, th FROM {SOFT} x JOIN b ON b.seed = x.seed),
    z AS (SELECT 'hard' AS method, * FROM ({cells_sql(WIDE, 'seed', '(d >= 0.409 AND q >= 0.48)')}) UNION ALL SELECT 'soft', * FROM ({cells_sql('s', 'seed', '(score >= th)')}))
    SELECT method, seed, tp, fp, tn, fn, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM z""")
def _(t):
    w = wide(t)
    hard = M.confusion(w, ["seed"], "y", (F.col("d") >= 0.409) & (F.col("q") >= 0.48)).withColumn("method", F.lit("hard"))
    s = w.withColumn("score", F.round(0.6 * F.col("d") + 0.4 * F.col("q"), 9))
    th = M.youden(M.roc_points(s, ["seed"], "score", "y"), ["seed"]).select("seed", "threshold")
    return hard.unionByName(M.confusion(s.join(F.broadcast(th), "seed"), ["seed"], "y", F.col("score") >= F.col("threshold")).withColumn("method", F.lit("soft")))


@query("temperature_scale", s="subject_id", f="p0 p1 p2", sql="""
    SELECT subject_id, pow(p0, 1 / 1.5::DOUBLE) / s AS p0, pow(p1, 1 / 1.5::DOUBLE) / s AS p1, pow(p2, 1 / 1.5::DOUBLE) / s AS p2 FROM (SELECT *, pow(p0, 1 / 1.5::DOUBLE) + pow(p1, 1 / 1.5::DOUBLE) + pow(p2, 1 / 1.5::DOUBLE) AS s FROM c_prob)""")
def _(t):
    return t.probabilities.select("subject_id", *[e.alias(k) for k, e in E.temperature(["p0", "p1", "p2"], 1.5).items()])


RAWP = "(SELECT subject_id, CASE WHEN k % 11 = 0 THEN -0.1::DOUBLE WHEN k % 13 = 0 THEN 0 ELSE p0 * 3 END AS p0, CASE WHEN k % 13 = 0 THEN 0 WHEN k % 17 = 0 THEN NULL ELSE p1 * 3 END AS p1, CASE WHEN k % 13 = 0 THEN 0 ELSE p2 * 3 END AS p2 FROM (SELECT *, CAST(subject_id AS BIGINT) AS k FROM c_prob))"


@query("normalise_probabilities", s="variant subject_id reason", f="p0 p1 p2", sql=f"""
    WITH r AS (SELECT *, CASE WHEN p0 IS NULL OR p1 IS NULL OR p2 IS NULL THEN 'not_finite' WHEN p0 < 0 OR p1 < 0 OR p2 < 0 THEN 'negative' WHEN p0 + p1 + p2 <= 0 THEN 'zero_mass' END AS reason FROM {RAWP}),
    c AS (SELECT subject_id, greatest(least(p0, 1), 1e-7) AS a, greatest(least(p1, 1), 1e-7) AS b, greatest(least(p2, 1), 1e-7) AS c, p1 IS NULL AS bad FROM {RAWP})
    SELECT 'reject' AS variant, subject_id, reason, CASE WHEN reason IS NULL THEN p0 / (p0 + p1 + p2) END AS p0, CASE WHEN reason IS NULL THEN p1 / (p0 + p1 + p2) END AS p1, CASE WHEN reason IS NULL THEN p2 / (p0 + p1 + p2) END AS p2 FROM r
    UNION ALL SELECT 'clip', subject_id, CASE WHEN bad THEN 'not_finite' END, CASE WHEN NOT bad THEN a / (a + b + c) END, CASE WHEN NOT bad THEN b / (a + b + c) END, CASE WHEN NOT bad THEN c / (a + b + c) END FROM c""")
def _(t):
    k = F.col("subject_id").cast("bigint")
    d = t.probabilities.select("subject_id", F.when(k % 11 == 0, -0.1).when(k % 13 == 0, 0.0).otherwise(F.col("p0") * 3).alias("p0"),
                               F.when(k % 13 == 0, 0.0).when(k % 17 == 0, F.lit(None)).otherwise(F.col("p1") * 3).alias("p1"), F.when(k % 13 == 0, 0.0).otherwise(F.col("p2") * 3).alias("p2"))
    c = ["p0", "p1", "p2"]
    return E.normalise(d, c).withColumn("variant", F.lit("reject")).unionByName(E.normalise(d, c, True).withColumn("variant", F.lit("clip")))


@query("class_prior_baseline", s="subject_id", i="majority", f="p0 p1 p2", sql="""
    WITH c AS (SELECT y3, count(*) AS n FROM c_cust WHERE fold <> 0 GROUP BY 1) SELECT subject_id, (SELECT y3 FROM c ORDER BY n DESC, y3 LIMIT 1) AS majority,
      (SELECT max(n) FILTER (WHERE y3 = 0) / sum(n) FROM c) AS p0, (SELECT max(n) FILTER (WHERE y3 = 1) / sum(n) FROM c) AS p1, (SELECT max(n) FILTER (WHERE y3 = 2) / sum(n) FROM c) AS p2 FROM c_cust WHERE fold = 0""")
def _(t):
    return E.prior_baseline(t.customers.where("fold <> 0"), t.customers.where("fold = 0"), "y3", [0, 1, 2])


VBOOT = weight_sql(93, DRAWS, "c_vec", "vec_id")


@query("contribution_summary", s="feature", i="rank top5_rows", f="mean_abs share fold_min fold_max low high", sql=f"""
    WITH g AS (SELECT feature, avg(abs(contribution)) AS m FROM c_contrib GROUP BY 1), f AS (SELECT feature, min(m) AS lo, max(m) AS hi FROM (SELECT feature, fold, avg(abs(contribution)) AS m FROM c_contrib GROUP BY 1, 2) GROUP BY 1),
    tp AS (SELECT feature, count(*) FILTER (WHERE r <= 5) AS t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(contribution) DESC, feature) AS r FROM c_contrib) GROUP BY 1), bw AS ({VBOOT}),
    b AS (SELECT feature, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT feature, draw, sum(abs(contribution) * weight) / sum(weight) AS m FROM c_contrib c JOIN bw ON bw.vec_id = c.vec_id GROUP BY 1, 2) GROUP BY 1)
    SELECT g.feature, m AS mean_abs, m / sum(m) OVER () AS share, row_number() OVER (ORDER BY m DESC, g.feature) AS rank, lo AS fold_min, hi AS fold_max, t AS top5_rows, low, high FROM g JOIN f ON f.feature = g.feature JOIN tp ON tp.feature = g.feature JOIN b ON b.feature = g.feature""")
def _(t):
    return E.contribution_summary(t.contributions, "vec_id", "feature", "contribution", "fold", DRAWS, 93)


@query("contribution_direction", s="feature", f="rho median_0 median_1 mean_0 mean_1", sql="""
    WITH r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature ORDER BY contribution) + (count(*) OVER (PARTITION BY feature, contribution) - 1) / 2.0::DOUBLE AS b FROM c_contrib)
    SELECT c.feature, rho, median_0, median_1, mean_0, mean_1 FROM (SELECT feature, median(value) FILTER (WHERE y = 0) AS median_0, median(value) FILTER (WHERE y = 1) AS median_1, avg(contribution) FILTER (WHERE y = 0) AS mean_0, avg(contribution) FILTER (WHERE y = 1) AS mean_1 FROM c_contrib GROUP BY 1) c
    JOIN (SELECT feature, corr(a, b) AS rho FROM r GROUP BY 1) q ON q.feature = c.feature""")
def _(t):
    return E.contribution_direction(t.contributions, "feature", "value", "contribution", "y")


@query("contribution_rank_stability", s="feature", i="min_rank max_rank folds_in_top always_top", f="mean_rank sd_rank", sql="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, feature) AS rank FROM (SELECT fold, feature, avg(abs(contribution)) AS m FROM c_contrib GROUP BY 1, 2))
    SELECT feature, avg(rank) AS mean_rank, stddev_samp(rank) AS sd_rank, min(rank) AS min_rank, max(rank) AS max_rank, count(*) FILTER (WHERE rank <= 3) AS folds_in_top, count(*) FILTER (WHERE rank <= 3) = 5 AS always_top FROM r GROUP BY 1""")
def _(t):
    return E.rank_stability(t.contributions, "feature", "contribution", "fold", 3)


@query("time_axis_aggregate", s="subject_id channel", f="abs_mean mean sum last", sql="""
    SELECT subject_id, channel, avg(abs(v)) AS abs_mean, avg(v) AS mean, sum(v) AS sum, arg_max(v, day_index) AS last FROM (SELECT *, value - 50 AS v FROM c_long WHERE value IS NOT NULL) GROUP BY 1, 2""")
def _(t):
    return E.over_time(t.long.withColumn("v", F.col("value") - 50), ["subject_id", "channel"], "day_index", "v")


@query("risk_score", i="fold n", f="risk max_risk", sql="SELECT fold, count(*) AS n, avg(r) AS risk, max(r) AS max_risk FROM (SELECT fold, vec_id, sum(greatest(contribution, 0)) AS r FROM c_contrib GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return E.risk(t.contributions, ["fold"], "vec_id", "contribution")


COEF = {c: (0.5 if i % 2 else -0.3) for i, c in enumerate(XS)}
LOGIT = " + ".join(f"({c} - {c}_mu) / {c}_sd * ({w})" for c, w in COEF.items())


@query("score_frozen_model", s="status", i="vec_id", f="score ecdf", sql=f"""
    WITH f AS ({FILL}), c AS ({CLIPPED.format(src='f')}), s AS (SELECT c.vec_id, c.fold, round(1 / (1 + exp(-({LOGIT} + 0.2::DOUBLE))), 9) AS score FROM c, {row(each(lambda c: f'avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd'), 'c WHERE fold <> 0')}),
    q AS (SELECT s.vec_id, score, v.n AS gaps FROM s JOIN (SELECT vec_id, {' + '.join(f'({c} IS NULL)::INT' for c in XS)} AS n FROM c_vn) v ON v.vec_id = s.vec_id WHERE fold = 0)
    SELECT q.vec_id, CASE WHEN gaps <= 0 THEN q.score END AS score, CASE WHEN gaps <= 0 THEN (SELECT (count(*) FILTER (WHERE r.score < q.score) + count(*) FILTER (WHERE r.score <= q.score)) / (2.0::DOUBLE * count(*)) FROM s r WHERE r.fold <> 0) END AS ecdf,
      CASE WHEN gaps <= 0 THEN 'scored' ELSE 'refused' END AS status FROM q""")
def _(t):
    gaps = F.size(F.filter(F.array(*XS), lambda x: x.isNull()))
    d = t.vectors_missing.withColumn("gaps", gaps)
    p = R.winsorise(d, d.where("fold <> 0"), XS)
    return E.score_frozen(p.where("fold <> 0"), p.where("fold = 0"), "vec_id", COEF, 0.2, "gaps", 0)
