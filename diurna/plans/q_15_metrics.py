"""Metrics, thresholds, inference, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import drift as D
from diurna.operators import inference as I
from diurna.operators import metrics as M
from diurna.plans.q_12_splits import feistel_sql, weight_sql
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

MS = ["model", "seed"]


def auc_sql(src: str, keys: str, score: str = "score", y: str = "y", w: str = "1") -> str:
    k = keys + "," if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return (f"SELECT {k} sum(pos) AS n_pos, sum(neg) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) END AS auc FROM "
            f"(SELECT *, sum(neg) OVER ({part} ORDER BY s) AS cn FROM (SELECT {k} {score} AS s, sum({w} * {y})::DOUBLE AS pos, sum({w} * (1 - {y}))::DOUBLE AS neg FROM {src} GROUP BY {k} {score})) {grp}")


def pts(src: str, keys: str, score: str = "score", y: str = "y") -> str:
    """Cut points (score >= cut) with counts, rates, neighbour and corner flag."""
    return (f"SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, (lp IS NULL OR lp <> pos OR ln <> neg) AS corner FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, "
            f"sum(pos) OVER (PARTITION BY {keys}) - sum(pos) OVER w AS fn, sum(neg) OVER (PARTITION BY {keys}) - sum(neg) OVER w AS tn, lead(pos) OVER w AS lp, lead(neg) OVER w AS ln, lag(cut) OVER w AS next_score "
            f"FROM (SELECT {keys}, {score} AS cut, sum({y})::DOUBLE AS pos, sum(1 - {y})::DOUBLE AS neg FROM {src} GROUP BY {keys}, {score}) WINDOW w AS (PARTITION BY {keys} ORDER BY cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")


PT = f"p AS ({pts('c_oof', 'model, seed')})"


def points(t):
    return M.roc_points(t.oof, MS, "score", "y")


@query("roc_auc", s="model", i="seed n_pos n_neg", f="auc", sql=auc_sql("c_oof", "model, seed"))
def _(t):
    return M.roc_auc(t.oof, MS, "score", "y")


@query("average_precision", s="model", i="seed", f="ap prevalence", sql=f"WITH {PT} SELECT model, seed, sum(pos / (tp + fn) * tp / (tp + fp)) AS ap, sum(pos) / sum(pos + neg) AS prevalence FROM p GROUP BY 1, 2")
def _(t):
    return M.average_precision(t.oof, MS, "score", "y")


RATES = "sensitivity specificity precision npv f1 accuracy balanced_accuracy mcc"
RATES_SQL = ("tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tn / nullif(tn + fn, 0), 0) AS npv, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + tn + fn) AS accuracy, "
             "(tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc")


def cells_sql(src: str, keys: str, pred: str, y: str = "y") -> str:
    return (f"SELECT {keys}, count(*) FILTER (WHERE {y} = 1 AND {pred})::DOUBLE AS tp, count(*) FILTER (WHERE {y} = 0 AND {pred})::DOUBLE AS fp, count(*) FILTER (WHERE {y} = 0 AND NOT {pred})::DOUBLE AS tn, "
            f"count(*) FILTER (WHERE {y} = 1 AND NOT {pred})::DOUBLE AS fn FROM {src} GROUP BY ALL")


@query("confusion_metrics", s="model", i="seed tp fp tn fn", f=RATES, sql=f"SELECT *, {RATES_SQL} FROM ({cells_sql('c_oof', 'model, seed', 'score >= 0.45')})")
def _(t):
    return M.confusion(t.oof, MS, "y", F.col("score") >= 0.45)


@query("brier_logloss", s="model", i="seed", f="brier logloss", sql="""
    SELECT model, seed, avg(pow(score - y, 2)) AS brier, -avg(y * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15))) AS logloss FROM c_oof GROUP BY 1, 2
    UNION ALL SELECT 'three', fold, avg(pow(p0 - (y3 = 0)::INT, 2) + pow(p1 - (y3 = 1)::INT, 2) + pow(p2 - (y3 = 2)::INT, 2)), -avg(ln(CASE y3 WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) FROM c_prob GROUP BY 1, 2""")
def _(t):
    m = M.multiclass_loss(t.probabilities, ["fold"], "y3", ["p0", "p1", "p2"]).select(F.lit("three").alias("model"), F.col("fold").alias("seed"), "brier", "logloss")
    return M.brier_logloss(t.oof, MS, "y", "score").unionByName(m)


AM = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
OVR = "(SELECT subject_id, unnest([0, 1, 2]) AS cls, unnest([p0, p1, p2]) AS score, unnest([(y3 = 0)::INT, (y3 = 1)::INT, (y3 = 2)::INT]) AS y FROM c_prob)"


@query("multiclass_metrics", i="cls support pred_0 pred_1 pred_2", f="precision recall f1 auc ap", sql=f"""
    WITH q AS (SELECT *, {AM} AS pred FROM c_prob), s AS (SELECT cls, count(*) FILTER (WHERE y3 = cls) AS support, coalesce(count(*) FILTER (WHERE y3 = cls AND pred = cls) / nullif(count(*) FILTER (WHERE pred = cls), 0)::DOUBLE, 0) AS precision,
        count(*) FILTER (WHERE y3 = cls AND pred = cls) / count(*) FILTER (WHERE y3 = cls)::DOUBLE AS recall, 2.0::DOUBLE * count(*) FILTER (WHERE y3 = cls AND pred = cls) / (count(*) FILTER (WHERE y3 = cls) + count(*) FILTER (WHERE pred = cls)) AS f1,
        {', '.join(f'count(*) FILTER (WHERE y3 = cls AND pred = {j}) AS pred_{j}' for j in range(3))} FROM q, (SELECT unnest([0, 1, 2]) AS cls) GROUP BY 1),
    a AS ({auc_sql(OVR, 'cls')}), p AS ({pts(OVR, 'cls')}), ap AS (SELECT cls, sum(pos / (tp + fn) * tp / (tp + fp)) AS ap FROM p GROUP BY 1),
    j AS (SELECT s.*, auc, ap FROM s JOIN a ON a.cls = s.cls JOIN ap ON ap.cls = s.cls)
    SELECT * FROM j UNION ALL SELECT -1, sum(support), avg(precision), avg(recall), avg(f1), sum(pred_0), sum(pred_1), sum(pred_2), avg(auc), avg(ap) FROM j""")
def _(t):
    return M.multiclass(t.probabilities, "y3", ["p0", "p1", "p2"])


@query("collapsed_binary_metrics", i="fold tp fp tn fn", f=RATES + " auc", sql=f"""
    WITH b AS (SELECT fold, (y3 > 0)::INT AS y, p1 + p2 AS score FROM c_prob), c AS (SELECT *, {RATES_SQL} FROM ({cells_sql('b', 'fold', 'score >= 0.5')})), a AS ({auc_sql('(SELECT fold, y, round(score, 9) AS score FROM b)', 'fold')})
    SELECT c.*, auc FROM c JOIN a ON a.fold = c.fold""")
def _(t):
    d = t.probabilities.select("fold", (F.col("y3") > 0).cast("int").alias("y"), (F.col("p1") + F.col("p2")).alias("score"))
    a = M.roc_auc(d.withColumn("score", F.round("score", 9)), ["fold"], "score", "y").select("fold", "auc")
    return M.confusion(d, ["fold"], "y", F.col("score") >= 0.5).join(a, "fold")


@query("sub_auc_decomposition", s="model", i="seed", f="merged cn_mci cn_dem weighted", sql=f"""
    WITH a AS ({auc_sql('c_oof', 'model, seed')}), b AS ({auc_sql('(SELECT * FROM c_oof WHERE y3 <> 2)', 'model, seed')}), c AS ({auc_sql('(SELECT * FROM c_oof WHERE y3 <> 1)', 'model, seed')})
    SELECT a.model, a.seed, a.auc AS merged, b.auc AS cn_mci, c.auc AS cn_dem, (b.n_pos * b.auc + c.n_pos * c.auc) / (b.n_pos + c.n_pos) AS weighted FROM a JOIN b ON a.model = b.model AND a.seed = b.seed JOIN c ON a.model = c.model AND a.seed = c.seed""")
def _(t):
    parts = F.explode(F.when(F.col("y3") == 0, F.array(F.lit("m"), F.lit("b"), F.lit("c"))).when(F.col("y3") == 1, F.array(F.lit("m"), F.lit("b"))).otherwise(F.array(F.lit("m"), F.lit("c"))))
    a = M.roc_auc(t.oof.withColumn("part", parts), [*MS, "part"], "score", "y")

    def v(p, c):
        return F.max(F.when(F.col("part") == p, F.col(c)))

    w = (v("b", "n_pos") * v("b", "auc") + v("c", "n_pos") * v("c", "auc")) / (v("b", "n_pos") + v("c", "n_pos"))
    return a.groupBy(*MS).agg(v("m", "auc").alias("merged"), v("b", "auc").alias("cn_mci"), v("c", "auc").alias("cn_dem"), w.alias("weighted"))


@query("precision_at_k", s="model", i="seed k n_positive", f="precision_at_k max_possible", sql="""
    SELECT model, seed, count(*) FILTER (WHERE r <= 100) AS k, sum(y) AS n_positive, avg(y) FILTER (WHERE r <= 100) AS precision_at_k, least(sum(y), count(*) FILTER (WHERE r <= 100)) / (count(*) FILTER (WHERE r <= 100))::DOUBLE AS max_possible
    FROM (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY score DESC, subject_id) AS r FROM c_oof) GROUP BY 1, 2""")
def _(t):
    return M.top_k_precision(t.oof, MS, "score", "y", 100, "subject_id")


@query("aggregate_to_subject", s="subject_id", i="y n", f="mean median last vote", sql="""
    SELECT subject_id, max(y) AS y, count(*) AS n, avg(score) AS mean, median(score) AS median, arg_max(score, (date, window_id)) AS last, avg((score >= 0.25)::INT) AS vote FROM c_ord GROUP BY 1""")
def _(t):
    d = t.order_scores.withColumn("pos", F.struct("date", "window_id"))
    return M.to_subject(d, "subject_id", "score", "y", "pos", 0.25)


@query("aggregate_repeated_oof", s="model subject_id", i="n complete", f="mean_score vote_rate sd_score", sql="""
    SELECT model, subject_id, count(*) AS n, count(*) = 3 AS complete, avg(score) AS mean_score, avg((score >= 0.45)::INT) AS vote_rate, stddev_samp(score) AS sd_score FROM c_oof GROUP BY 1, 2""")
def _(t):
    return M.repeated_oof(t.oof_by_subject, ["model", "subject_id"], "score", 0.45, 3)


@query("oof_pivot", s="model subject_id", f="s0 s1 s2", sql="SELECT model, subject_id, max(score) FILTER (WHERE seed = 0) AS s0, max(score) FILTER (WHERE seed = 1) AS s1, max(score) FILTER (WHERE seed = 2) AS s2 FROM c_oof GROUP BY 1, 2")
def _(t):
    p = t.oof_by_subject.groupBy("model", "subject_id").pivot("seed", [0, 1, 2]).agg(F.max("score"))
    return p.withColumnsRenamed({str(k): f"s{k}" for k in range(3)})


@query("threshold_youden", s="model", i="seed n_degenerate", f="threshold value", sql=f"""
    WITH {PT} SELECT model, seed, coalesce(-max(k).c, 0.5) AS threshold, max(k).j AS value, count(*) FILTER (WHERE k IS NULL) AS n_degenerate FROM (SELECT *, CASE WHEN tp + fp > 0 AND tn + fn > 0 THEN {{'j': round(tpr - fpr, 12), 'c': -cut}} END AS k FROM p) GROUP BY 1, 2""")
def _(t):
    return M.youden(points(t), MS)


@query("threshold_balanced", s="model", i="seed", f="threshold value", sql=f"""
    WITH {PT} SELECT model, seed, -max(k).c AS threshold, max(k).v AS value FROM (SELECT *, {{'v': round(((tp - pos) / (tp + fn) + (tn + neg) / (fp + tn)) / 2, 12), 'c': -(cut + next_score) / 2}} AS k FROM p WHERE next_score IS NOT NULL) GROUP BY 1, 2""")
def _(t):
    return M.balanced_cut(points(t), MS)


@query("threshold_specificity_target", s="model", i="seed", f="threshold", sql=f"WITH {PT} SELECT model, seed, coalesce(min(cut) FILTER (WHERE tn / (tn + fp) >= 0.8), max(cut) + 1e-6) AS threshold FROM p GROUP BY 1, 2")
def _(t):
    return M.specificity_cut(points(t), MS, 0.8)


@query("threshold_tiers", s="model", i="seed", f="tier1_screen tier2_diag tier3_conf", sql=f"""
    WITH {PT}, b AS (SELECT model, seed, max({{'j': round(tpr - fpr, 12), 'c': cut}}).c AS best, max(cut) FILTER (WHERE tpr >= 0.75) AS a, min(cut) FILTER (WHERE 1 - fpr >= 0.8) AS c FROM p WHERE corner GROUP BY 1, 2)
    SELECT model, seed, coalesce(a, best) AS tier1_screen, best AS tier2_diag, coalesce(c, best) AS tier3_conf FROM b""")
def _(t):
    return M.tier_cuts(points(t), MS)


@query("threshold_quantile_transfer", s="subject_id model", i="seed prediction", f="q", sql=f"""
    WITH p AS ({pts('(SELECT * FROM c_oof WHERE fold <> 0)', 'model, seed')}), b AS (SELECT model, seed, max({{'j': round(tpr - fpr, 12), 'c': cut, 'q': (tn + fn) / (tp + fp + tn + fn)}}).q AS q FROM p GROUP BY 1, 2),
    r AS (SELECT *, (rank() OVER (PARTITION BY model, seed ORDER BY score) + (count(*) OVER (PARTITION BY model, seed, score) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY model, seed) AS pct FROM c_oof WHERE fold = 0)
    SELECT subject_id, r.model, r.seed, q, pct >= q AS prediction FROM r JOIN b ON r.model = b.model AND r.seed = b.seed""")
def _(t):
    return M.quantile_transfer(t.oof.where("fold <> 0"), t.oof.where("fold = 0"), MS, "score", "y")


@query("operating_point", s="model", i="seed", f="threshold sensitivity specificity", sql=f"""
    WITH {PT} SELECT model, seed, -m.c AS threshold, m.tpr AS sensitivity, 1 - m.fpr AS specificity FROM (SELECT model, seed, min({{'d': round(abs(tpr - 0.7), 12), 'c': -cut, 'tpr': tpr, 'fpr': fpr}}) AS m FROM p WHERE corner GROUP BY 1, 2)""")
def _(t):
    return M.operating_point(points(t), MS, 0.7)


@query("implied_prevalence", s="model", i="seed", f="prevalence", sql=f"""
    SELECT model, seed, CASE WHEN v > 0 AND v <= 1 THEN v END AS prevalence FROM (SELECT model, seed, (-pr * (1 - sp)) / (pr * se - pr * (1 - sp) - se) AS v FROM (SELECT model, seed, tp / (tp + fn) AS se, tn / (tn + fp) AS sp, tp / (tp + fp) AS pr FROM ({cells_sql('c_oof', 'model, seed', 'score >= 0.45')})))""")
def _(t):
    c = M.confusion(t.oof, MS, "y", F.col("score") >= 0.45)
    return c.select(*MS, M.implied_prevalence(F.col("sensitivity"), F.col("specificity"), F.col("precision")).alias("prevalence"))


@query("calibration_bins", s="model", i="seed bin n", f="mean_predicted observed_rate", sql="SELECT model, seed, greatest(least(floor(score * 10), 9), 0) AS bin, count(*) AS n, avg(score) AS mean_predicted, avg(y) AS observed_rate FROM c_oof GROUP BY 1, 2, 3")
def _(t):
    return M.calibration(t.oof, MS, "y", "score")


BOOT = f"bw AS ({weight_sql(61, I.DRAWS, 'c_cust')}), bd AS (SELECT o.model, o.seed, bw.draw, o.score, o.y, bw.weight AS w FROM c_oof o JOIN bw ON bw.subject_id = o.subject_id), ba AS ({auc_sql('bd', 'model, seed, draw', w='w')})"


@query("bootstrap_ci", s="model", i="seed n_draws", f="auc low high", sql=f"""
    WITH {BOOT}, o AS ({auc_sql('c_oof', 'model, seed')}) SELECT o.model, o.seed, o.auc, n_draws, low, high FROM o JOIN (SELECT model, seed, count(auc) AS n_draws, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM ba GROUP BY 1, 2) c ON c.model = o.model AND c.seed = o.seed""")
def _(t):
    return I.bootstrap_ci(t.oof, "subject_id", "score", "y", MS, seed=61)


@query("paired_bootstrap_diff", i="seed n_draws", f="observed low high", sql=f"""
    WITH {BOOT}, o AS ({auc_sql('c_oof', 'model, seed')}), d AS (SELECT seed, draw, max(auc) FILTER (WHERE model = 'a') - max(auc) FILTER (WHERE model = 'b') AS d FROM ba GROUP BY 1, 2)
    SELECT x.seed, observed, n_draws, low, high FROM (SELECT seed, max(auc) FILTER (WHERE model = 'a') - max(auc) FILTER (WHERE model = 'b') AS observed FROM o GROUP BY 1) x JOIN (SELECT seed, count(d) AS n_draws, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY 1) y ON x.seed = y.seed""")
def _(t):
    return I.paired_difference(t.oof, "subject_id", "score", "y", "model", "a", "b", ["seed"], seed=61)


@query("hanley_mcneil_se", s="model", i="seed", f="auc se wald_low wald_high logit_low logit_high", sql=f"""
    WITH a AS ({auc_sql('c_oof', 'model, seed')}), s AS (SELECT *, sqrt((auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg)) AS se FROM a)
    SELECT model, seed, auc, se, auc - 1.96::DOUBLE * se AS wald_low, auc + 1.96::DOUBLE * se AS wald_high, 1 / (1 + exp(-(ln(auc / (1 - auc)) - 1.96::DOUBLE * se / (auc * (1 - auc))))) AS logit_low, 1 / (1 + exp(-(ln(auc / (1 - auc)) + 1.96::DOUBLE * se / (auc * (1 - auc))))) AS logit_high FROM s""")
def _(t):
    a = M.roc_auc(t.oof, MS, "score", "y")
    return a.select(*MS, "auc", *[e.alias(k) for k, e in I.hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg")).items()])


FA = auc_sql("c_oof", "model, seed, fold")


@query("fold_variability", s="model", i="n", f="mean sd min max t_low t_high", sql=f"""
    SELECT model, count(*) AS n, avg(auc) AS mean, stddev_samp(auc) AS sd, min(auc) AS min, max(auc) AS max, avg(auc) - 2.144787::DOUBLE * stddev_samp(auc) / sqrt(15) AS t_low, avg(auc) + 2.144787::DOUBLE * stddev_samp(auc) / sqrt(15) AS t_high FROM ({FA}) GROUP BY 1""")
def _(t):
    return I.variability(M.roc_auc(t.oof, [*MS, "fold"], "score", "y"), ["model"], "auc")


ONES_FIRST = "SELECT subject_id, row_number() OVER (ORDER BY y DESC, md5(subject_id), subject_id) - 1 AS spot, count(*) OVER () AS n, sum(y) OVER () AS ones FROM c_cust"
NULL = f"{feistel_sql(ONES_FIRST, I.PERMUTATIONS, 71)}, nd AS (SELECT o.model, o.seed, np.perm, (np.x < np.ones)::INT AS y, o.score FROM placed np JOIN c_oof o ON o.subject_id = np.subject_id), na AS ({auc_sql('nd', 'model, seed, perm')})"


@query("permutation_p", s="model", i="seed n", f="observed p null_mean null_median null_p95", sql=f"""
    WITH RECURSIVE {NULL}, o AS ({auc_sql('c_oof', 'model, seed')}) SELECT o.model, o.seed, o.auc AS observed, count(na.auc) AS n, (count(*) FILTER (WHERE na.auc >= o.auc) + 1) / (count(na.auc) + 1)::DOUBLE AS p, avg(na.auc) AS null_mean, median(na.auc) AS null_median,
      quantile_cont(na.auc, 0.95) AS null_p95 FROM na JOIN o ON o.model = na.model AND o.seed = na.seed GROUP BY ALL""")
def _(t):
    return I.permutation_test(t.oof, MS, "subject_id", "score", "y", seed=71)


WELCH = """SELECT feature, n0, n1, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t, pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS df FROM (SELECT feature, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
    avg(value) FILTER (WHERE y = 0) AS m0, avg(value) FILTER (WHERE y = 1) AS m1, var_samp(value) FILTER (WHERE y = 0) AS v0, var_samp(value) FILTER (WHERE y = 1) AS v1 FROM c_vl GROUP BY 1)"""


def t_tail(src: str, keep: str) -> str:
    """Two-sided p of t with df degrees of freedom: Simpson's rule on both integrals of the incomplete beta function."""
    def area(top: str) -> str:
        return f"sum(c * pow(sin({top} * i / 4000.0::DOUBLE), df - 1)) * {top}"

    return f"""SELECT {keep}, {area('hi')} / ({area('pi() / 2')}) AS p FROM (SELECT *, asin(sqrt(df / (df + t * t))) AS hi FROM ({src})),
      (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT unnest(range(4001)) AS i)) GROUP BY {keep}, hi"""


def p_table(t):
    return I.welch(t.vector_long, ["feature"], "y", "value").select("feature", I.two_sided_t_p("t", "df").alias("p"))


@query("holm_adjust", s="feature", f="p p_holm", sql=f"""
    WITH p AS (SELECT feature, p FROM ({t_tail(WELCH, 'feature, t, df')})) SELECT feature, p, least(1, max(s) OVER (ORDER BY p, feature)) AS p_holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, feature) + 1) * p AS s FROM p)""")
def _(t):
    return I.holm(p_table(t), "feature", "p")


@query("bh_fdr", s="feature", f="p q", sql=f"""
    WITH p AS (SELECT feature, p FROM ({t_tail(WELCH, 'feature, t, df')})) SELECT feature, p, least(1, min(s) OVER (ORDER BY p DESC, feature DESC)) AS q FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS s FROM p)""")
def _(t):
    return I.bh(p_table(t), "feature", "p")


@query("winner_bias", i="n_draws", f="mean_max observed_max bias", sql=f"""
    WITH {BOOT}, o AS ({auc_sql('c_oof', 'model, seed')}), om AS (SELECT max(auc - (SELECT auc FROM o WHERE model = 'a' AND seed = 0)) AS om FROM o WHERE NOT (model = 'a' AND seed = 0)),
    dm AS (SELECT draw, max(auc - base) AS g FROM (SELECT *, max(auc) FILTER (WHERE model = 'a' AND seed = 0) OVER (PARTITION BY draw) AS base FROM ba) WHERE NOT (model = 'a' AND seed = 0) GROUP BY 1)
    SELECT count(g) AS n_draws, avg(g) AS mean_max, max(om) AS observed_max, avg(g) - max(om) AS bias FROM dm, om""")
def _(t):
    d = t.oof.withColumn("arm", F.concat("model", "seed"))
    return I.winner_bias(d, "subject_id", "score", "y", "arm", "a0", seed=61)


@query("leave_one_two_out_delta", i="removed evaluations", f="positive_fraction min_delta", sql=f"""
    WITH s AS (SELECT y3 AS t, {AM} AS a, CASE WHEN p0 * 1.3::DOUBLE >= p1 AND p0 * 1.3::DOUBLE >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS b FROM c_prob),
    c AS (SELECT t, a, b, count(*) AS n FROM s GROUP BY 1, 2, 3),
    rm AS (SELECT 1 AS removed, t AS t1, a AS a1, b AS b1, NULL::INT AS t2, NULL::INT AS a2, NULL::INT AS b2, n AS times FROM c
      UNION ALL SELECT 2, x.t, x.a, x.b, z.t, z.a, z.b, CASE WHEN (x.t, x.a, x.b) = (z.t, z.a, z.b) THEN x.n * (x.n - 1) / 2 ELSE x.n * z.n END FROM c x JOIN c z ON (x.t, x.a, x.b) <= (z.t, z.a, z.b)),
    f AS (SELECT removed, t1, a1, b1, t2, a2, b2, times, k,
      sum(CASE WHEN c.t = k AND c.a = k THEN c.n ELSE 0 END) - (t1 = k AND a1 = k)::INT - coalesce((t2 = k AND a2 = k)::INT, 0) AS tpa, sum(CASE WHEN c.t = k THEN c.n ELSE 0 END) - (t1 = k)::INT - coalesce((t2 = k)::INT, 0) AS sup,
      sum(CASE WHEN c.a = k THEN c.n ELSE 0 END) - (a1 = k)::INT - coalesce((a2 = k)::INT, 0) AS pa, sum(CASE WHEN c.t = k AND c.b = k THEN c.n ELSE 0 END) - (t1 = k AND b1 = k)::INT - coalesce((t2 = k AND b2 = k)::INT, 0) AS tpb,
      sum(CASE WHEN c.b = k THEN c.n ELSE 0 END) - (b1 = k)::INT - coalesce((b2 = k)::INT, 0) AS pb FROM rm, (SELECT unnest([0, 1, 2]) AS k), c WHERE times > 0 GROUP BY removed, t1, a1, b1, t2, a2, b2, times, k),
    d AS (SELECT removed, t1, a1, b1, t2, a2, b2, times, avg(2.0::DOUBLE * tpa / (sup + pa)) - avg(2.0::DOUBLE * tpb / (sup + pb)) AS delta FROM f GROUP BY ALL)
    SELECT removed, sum(times) AS evaluations, sum(CASE WHEN delta > 0 THEN times ELSE 0 END) / sum(times)::DOUBLE AS positive_fraction, min(delta) AS min_delta FROM d GROUP BY 1""")
def _(t):
    d = t.probabilities.withColumn("q0", F.col("p0") * 1.3)
    d = d.select("y3", M.argmax(["p0", "p1", "p2"]).alias("a"), M.argmax(["q0", "p1", "p2"]).alias("b"))
    return I.leave_out_deltas(d, "y3", "a", "b")



@query("optimism_gap", s="model", f="nested non_nested gap", sql=f"SELECT model, avg(auc) AS nested, max(auc) AS non_nested, max(auc) - avg(auc) AS gap FROM ({auc_sql('c_oof', 'model, seed')}) GROUP BY 1")
def _(t):
    a = M.roc_auc(t.oof, MS, "score", "y")
    nested = a.groupBy("model").agg(F.avg("auc").alias("nested"))
    best = a.groupBy("model").agg(F.max("auc").alias("non_nested"))
    return nested.join(best, "model").withColumn("gap", F.col("non_nested") - F.col("nested"))


@query("paper_comparison", s="model", i="reported_rank measured_rank rank_change", f="reported measured delta", sql=f"""
    WITH m AS (SELECT model || seed AS model, auc FROM ({auc_sql('c_oof', 'model, seed')})), j AS (SELECT m.model, r.v AS reported, auc AS measured FROM m JOIN (VALUES ('a0', 0.71::DOUBLE), ('a1', 0.69::DOUBLE), ('b0', 0.70::DOUBLE), ('b2', 0.66::DOUBLE)) AS r(model, v) ON r.model = m.model),
    k AS (SELECT *, rank() OVER (ORDER BY reported DESC) AS reported_rank, rank() OVER (ORDER BY measured DESC) AS measured_rank FROM j) SELECT *, measured - reported AS delta, reported_rank - measured_rank AS rank_change FROM k""")
def _(t):
    from diurna.operators.audit import compare_reported

    m = M.roc_auc(t.oof.withColumn("arm", F.concat("model", "seed")), ["arm"], "score", "y").withColumnRenamed("arm", "model")
    return compare_reported(m, "model", "auc", {"a0": 0.71, "a1": 0.69, "b0": 0.70, "b2": 0.66})


@query("welch_t", s="feature", i="n0 n1", f="t df p", sql=t_tail(WELCH, "feature, n0, n1, t, df"))
def _(t):
    return I.welch(t.vector_long, ["feature"], "y", "value").withColumn("p", I.two_sided_t_p("t", "df"))


def one_t(src: str) -> str:
    return f"""SELECT feature, r AS reference_mean, n, m AS mean, s AS sd, (m - r) / (s / sqrt(n)) AS t, n - 1.0::DOUBLE AS df FROM (SELECT feature, avg(value) FILTER (WHERE y = 0) AS r, count(value) FILTER (WHERE y = 1) AS n, avg(value) FILTER (WHERE y = 1) AS m, stddev_samp(value) FILTER (WHERE y = 1) AS s FROM {src} GROUP BY 1)"""


ONE_T = f"SELECT 'rows' AS level, * FROM ({one_t('c_vl')}) UNION ALL SELECT 'subjects', * FROM ({one_t('(SELECT feature, label, y, avg(value) AS value FROM c_vl GROUP BY 1, 2, 3)')})"


@query("one_sample_t", s="level feature", i="n", f="reference_mean mean sd t p p_greater", sql=f"SELECT *, CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END AS p_greater FROM ({t_tail(ONE_T, 'level, feature, reference_mean, n, mean, sd, t, df')})")
def _(t):
    # the label stands for the subject: y is a function of it
    means = t.vector_long.groupBy("feature", "label", "y").agg(F.avg("value").alias("value"))
    rows, subjects = (I.one_sample_t(d, ["feature"], "value", "y", 0, 1) for d in (t.vector_long, means))
    d = rows.withColumn("level", F.lit("rows")).unionByName(subjects.withColumn("level", F.lit("subjects")))
    d = d.withColumn("p", I.two_sided_t_p("t", (F.col("n") - 1).cast("double")))
    return d.withColumn("p_greater", F.when(F.col("t") > 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))


def reml_sql(rows: str, by: str) -> str:
    """The sums of the restricted likelihood at ``ratio`` for every row of ``rows``, and its slope."""
    sums = ", ".join(f"sum(pow(n / (1 + ratio * n), {p}) * {t}) AS s{p}{name}" for p in (1, 2) for name, t in (("", "k"), ("x", "k * x"), ("xx", "k * x * x"), ("m", "sm"), ("xm", "x * sm"), ("mm", "smm")))
    return (f"SELECT *, ss + s1mm - b0 * s1m - b1 * s1xm AS rss, -0.5 * ((nn - 2) * (2 * b0 * s2m + 2 * b1 * s2xm - s2mm - b0 * b0 * s2 - 2 * b0 * b1 * s2x - b1 * b1 * s2xx) / (ss + s1mm - b0 * s1m - b1 * s1xm) + s1 - (s1xx * s2 - 2 * s1x * s2x + s1 * s2xx) / det) AS slope "
            f"FROM (SELECT *, (s1 * s1xm - s1x * s1m) / det AS b1, (s1xx * s1m - s1x * s1xm) / det AS b0 FROM (SELECT *, s1 * s1xx - s1x * s1x AS det FROM "
            f"(SELECT {by}, ratio, {sums}, sum(ss) AS ss, sum(k * n) AS nn, sum(k * ln(1 + ratio * n)) AS ld FROM ({rows}), cells GROUP BY {by}, ratio)))")


@query("random_intercept_test", f="ratio beta se sigma2 z p criterion", digits=5, sql=f"""
    WITH RECURSIVE per AS (SELECT subject_id, max(y)::DOUBLE AS x, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) AS v FROM (SELECT d.subject_id, y, v_max AS v FROM c_day d JOIN c_subj s ON s.subject_id = d.subject_id WHERE v_max IS NOT NULL) GROUP BY 1),
    cells AS (SELECT n, x, count(*)::DOUBLE AS k, sum(m - c) AS sm, sum((m - c) * (m - c)) AS smm, sum(n * v) AS ss FROM per, (SELECT sum(n * m) / sum(n) AS c FROM per) GROUP BY n, x),
    b AS (SELECT 0 AS i, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi UNION ALL
      SELECT i + 1, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE (lo + hi) / 2 END FROM ({reml_sql('SELECT *, exp((lo + hi) / 2) AS ratio FROM b WHERE i < 60', 'i, lo, hi')})),
    f AS ({reml_sql("SELECT 0 AS i, CASE WHEN lo < -29 THEN 0 ELSE exp((lo + hi) / 2) END AS ratio FROM b WHERE i = 60", 'i')}),
    e AS (SELECT *, rss / (nn - 2) AS s2_, b1 / sqrt(rss / (nn - 2) * s1 / det) AS zz FROM f)
    SELECT ratio, b1 AS beta, sqrt(s2_ * s1 / det) AS se, s2_ AS sigma2, zz AS z, -0.5 * ((nn - 2) * ln(s2_) + ld + ln(det)) AS criterion,
      (SELECT sum(CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(zz) + j / 400.0::DOUBLE, 2) / 2)) / 1200 * 2 / sqrt(2 * pi()) FROM (SELECT unnest(range(4001)) AS j)) AS p FROM e""")
def _(t):
    d = t.daily.join(t.subjects.select("subject_id", "y"), "subject_id")
    return I.random_intercept(d, "subject_id", "y", "v_max")


# ------------------------------------------------------------------ drift
SIDE = "(SELECT *, (fold = 0)::INT AS side FROM c_vl)"


def sided(t):
    return t.vector_long.withColumn("side", (F.col("fold") == 0).cast("int"))


CDF = f"""cd AS (SELECT feature, value, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nx
    FROM (SELECT feature, value, sum(1 - side)::DOUBLE AS a, sum(side)::DOUBLE AS b FROM {SIDE} GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value))"""


@query("ks_two_sample", s="feature", i="n_a n_b", f="ks", sql=f"WITH {CDF} SELECT c.feature, n_a, n_b, ks FROM (SELECT feature, max(abs(fa - fb)) AS ks FROM cd GROUP BY 1) c JOIN (SELECT feature, sum(1 - side) AS n_a, sum(side) AS n_b FROM {SIDE} GROUP BY 1) n ON n.feature = c.feature")
def _(t):
    return D.ks(sided(t), "feature", "value", "side")


@query("psi_drift", s="feature", i="n_bins", f="psi", sql=f"""
    WITH e AS (SELECT feature, [{', '.join(f'quantile_cont(value, {k / 10})' for k in range(1, 10))}] AS e FROM {SIDE} WHERE side = 0 GROUP BY 1),
    b AS (SELECT s.feature, len(list_filter(e, lambda z: z < value)) AS bin, sum(1 - side) AS a, sum(side) AS b FROM {SIDE} s JOIN e ON e.feature = s.feature GROUP BY 1, 2),
    p AS (SELECT *, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS pb FROM b)
    SELECT feature, count(*) AS n_bins, sum((pa - pb) * ln(pa / pb)) AS psi FROM p GROUP BY 1""")
def _(t):
    return D.psi(sided(t), "feature", "value", "side")


RATIOS = {f"ratio_{100 * q:g}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}


@query("wasserstein_1d", s="feature", f="wasserstein sd_ratio " + " ".join(RATIOS), sql=f"""
    WITH {CDF} SELECT c.feature, wasserstein, sd_ratio, {', '.join(RATIOS)} FROM (SELECT feature, sum(abs(fa - fb) * (nx - value)) AS wasserstein FROM cd WHERE nx IS NOT NULL GROUP BY 1) c
    JOIN (SELECT feature, stddev_samp(value) FILTER (WHERE side = 1) / stddev_samp(value) FILTER (WHERE side = 0) AS sd_ratio,
      {', '.join(f'quantile_cont(value, {q}) FILTER (WHERE side = 1) / nullif(quantile_cont(value, {q}) FILTER (WHERE side = 0), 0) AS {n}' for n, q in RATIOS.items())} FROM {SIDE} GROUP BY 1) m ON m.feature = c.feature""")
def _(t):
    w = D.wasserstein(sided(t), "feature", "value", "side").join(D.quantile_ratios(sided(t), "feature", "value", "side", RATIOS), "feature")
    return w.join(D.moments(sided(t), "feature", "value", "side").select("feature", "sd_ratio"), "feature")


XS = list(FEATURES)


@query("correlation_matrix_diff", i="n_features", f="frobenius mean_abs max_abs", sql=f"""
    WITH r AS (SELECT a.feature AS p, b.feature AS q, corr(a.value, b.value) FILTER (WHERE a.fold = 0) - corr(a.value, b.value) FILTER (WHERE a.fold <> 0) AS d FROM c_vl a JOIN c_vl b ON a.vec_id = b.vec_id
      AND CAST(substr(a.feature, 2) AS INTEGER) < CAST(substr(b.feature, 2) AS INTEGER) GROUP BY 1, 2)
    SELECT {len(XS)} AS n_features, sqrt(2 * sum(d * d)) AS frobenius, 2 * sum(abs(d)) / {len(XS) ** 2} AS mean_abs, max(abs(d)) AS max_abs FROM r""")
def _(t):
    return D.correlation_difference(t.vectors.withColumn("side", (F.col("fold") == 0).cast("int")), XS, "side")


def synth_sql():
    return f"(SELECT vec_id + 1000000000 AS vec_id, {', '.join(f'{c} * 0.9::DOUBLE AS {c}' for c in XS)} FROM c_vec WHERE fold = 1)"


def nn_sql(q: str, r: str, self_: bool = False) -> str:
    d = " + ".join(f"pow(q.{c} - r.{c}, 2)" for c in XS)
    return f"SELECT q.vec_id, min(sqrt({d})) AS d FROM {q} q, {r} r {'WHERE q.vec_id <> r.vec_id' if self_ else ''} GROUP BY 1"


TR, HO = "(SELECT * FROM c_vec WHERE fold <> 0)", "(SELECT * FROM c_vec WHERE fold = 0)"


def synth(t):
    return t.vectors.where("fold = 1").select((F.col("vec_id") + 1000000000).alias("vec_id"), *[(F.col(c) * 0.9).alias(c) for c in XS])


@query("nearest_neighbour_distance", i="vec_id", f="distance", sql=f"SELECT vec_id, d AS distance FROM ({nn_sql(synth_sql(), TR)})")
def _(t):
    return D.nearest_distance(synth(t), t.vectors.where("fold <> 0"), XS, "vec_id")


@query("memorisation_report", i="n_synthetic", f="train_median train_p05 holdout_median baseline_median exact_rate near_rate ratio", sql=f"""
    WITH a AS ({nn_sql(synth_sql(), TR)}), b AS ({nn_sql(synth_sql(), HO)}), c AS ({nn_sql(TR, TR, True)})
    SELECT count(*) AS n_synthetic, median(d) AS train_median, quantile_cont(d, 0.05) AS train_p05, (SELECT median(d) FROM b) AS holdout_median, (SELECT median(d) FROM c) AS baseline_median, avg((d = 0)::INT) AS exact_rate, avg((d < 0.01 * sqrt(8))::INT) AS near_rate, median(d) / (SELECT median(d) FROM b) AS ratio FROM a""")
def _(t):
    return D.memorisation(synth(t), t.vectors.where("fold <> 0"), t.vectors.where("fold = 0"), XS, "vec_id")


@query("variance_collapse", i="n_below_half n_features suspected", f="ratio_median ratio_min ratio_max", sql=f"""
    WITH m AS (SELECT feature, stddev_samp(value * CASE WHEN feature < 'x4' THEN 0.4::DOUBLE ELSE 1 END) FILTER (WHERE side = 1) / stddev_samp(value) FILTER (WHERE side = 0) AS r FROM {SIDE} GROUP BY 1)
    SELECT median(r) AS ratio_median, min(r) AS ratio_min, max(r) AS ratio_max, count(*) FILTER (WHERE r < 0.5) AS n_below_half, count(*) AS n_features, median(r) < 0.5 AS suspected FROM m""")
def _(t):
    d = sided(t).withColumn("value", F.when((F.col("side") == 1) & (F.col("feature") < "x4"), F.col("value") * 0.4).otherwise(F.col("value")))
    return D.variance_collapse(d, "feature", "value", "side")
