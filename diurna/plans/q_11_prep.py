"""Fold-local preprocessing: train = every fold but 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import neighbours as N
from diurna.operators import prep as R
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

XS = list(FEATURES)
XF = " ".join(XS)


def sides(t):
    d = t.vectors_missing
    return d, d.where("fold <> 0")


def row(exprs: str, src: str = "c_vn WHERE fold <> 0") -> str:
    return f"(SELECT {exprs} FROM {src}) AS prm"


def each(f) -> str:
    return ", ".join(f(c) for c in XS)


MED = row(each(lambda c: f"median({c}) AS {c}_med"))
FILL = f"SELECT vec_id, fold, {each(lambda c: f'coalesce({c}, {c}_med) AS {c}')} FROM c_vn, {MED}"


@query("median_impute_fit_apply", i="vec_id", f=XF, sql=FILL)
def _(t):
    d, tr = sides(t)
    return R.median_impute(d, tr, XS)


def knn_sql() -> str:
    parts = []
    for c in XS:
        dist = " + ".join(f"coalesce(pow(q.{x} - r.{x}, 2), 0)" for x in XS)
        cnt = " + ".join(f"(q.{x} IS NOT NULL AND r.{x} IS NOT NULL)::INT" for x in XS)
        parts.append(f"SELECT vec_id, '{c}' AS f, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) AS rn FROM (SELECT q.vec_id, r.vec_id AS rid, r.{c} AS v, "
                     f"sqrt(({dist}) * 8 / ({cnt})) AS d FROM c_vn q, c_vn r WHERE q.{c} IS NULL AND r.{c} IS NOT NULL AND r.fold <> 0)) WHERE rn <= 5 GROUP BY 1")
    return f"WITH m AS ({' UNION ALL '.join(parts)}) SELECT v.vec_id, {each(lambda c: f'coalesce(v.{c}, (SELECT m.v FROM m WHERE m.vec_id = v.vec_id AND m.f = {repr(c)})) AS {c}')} FROM c_vn v"


@query("knn_impute", i="vec_id", f=XF, sql=knn_sql())
def _(t):
    d, tr = sides(t)
    return N.knn_impute(d, tr, XS, "vec_id", 5)


@query("standard_scale", i="vec_id", f=XF, sql=f"SELECT vec_id, {each(lambda c: f'({c} - {c}_mu) / {c}_sd AS {c}')} FROM c_vn, {row(each(lambda c: f'avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd'))}")
def _(t):
    d, tr = sides(t)
    return R.standard_scale(d, tr, XS)


@query("minmax_scale_padded", i="vec_id", f=XF, sql=f"""
    SELECT vec_id, {each(lambda c: f'CASE WHEN {c} IS NULL THEN -1 ELSE greatest(least(({c} - {c}_lo) / ({c}_hi - {c}_lo), 1), 0) END AS {c}')} FROM c_vn, {row(each(lambda c: f'min({c}) AS {c}_lo, max({c}) AS {c}_hi'))}""")
def _(t):
    d = t.vectors_missing.fillna(-1.0, XS)
    return R.minmax_scale(d, d.where("fold <> 0"), XS)


@query("robust_scale", i="vec_id", f=XF, sql=f"""
    SELECT vec_id, {each(lambda c: f'({c} - {c}_med) / ({c}_q3 - {c}_q1) AS {c}')} FROM c_vn, {row(each(lambda c: f'median({c}) AS {c}_med, quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3'))}""")
def _(t):
    d, tr = sides(t)
    return R.robust_scale(d, tr, XS)


CLIPPED = f"SELECT vec_id, fold, {each(lambda c: f'greatest(least({c}, {c}_hi), {c}_lo) AS {c}')} FROM {{src}}, {row(each(lambda c: f'quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi'), '{src} WHERE fold <> 0')}"


@query("winsorise", i="vec_id", f=XF, sql=f"""
    WITH f AS ({FILL}), c AS ({CLIPPED.format(src='f')})
    SELECT vec_id, {each(lambda c: f'({c} - {c}_mu) / {c}_sd AS {c}')} FROM c, {row(each(lambda c: f'avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd'), 'c WHERE fold <> 0')}""")
def _(t):
    d, tr = sides(t)
    return R.winsorise(d, tr, XS)


HEAVY = ["x1", "x3", "x5"]


@query("signed_log_transform", i="vec_id", f=XF, sql=f"""
    WITH l AS (SELECT vec_id, fold, {each(lambda c: f'sign({c}) * ln(1 + abs({c})) AS {c}' if c in HEAVY else c)} FROM c_vn),
    f AS (SELECT vec_id, fold, {each(lambda c: f'coalesce({c}, {c}_med) AS {c}')} FROM l, {row(each(lambda c: f'median({c}) AS {c}_med'), 'l WHERE fold <> 0')}), c AS ({CLIPPED.format(src='f')})
    SELECT vec_id, {each(lambda c: f'({c} - {c}_med) / ({c}_q3 - {c}_q1) AS {c}')} FROM c, {row(each(lambda c: f'median({c}) AS {c}_med, quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3'), 'c WHERE fold <> 0')}""")
def _(t):
    d, tr = sides(t)
    return R.signed_log_scale(d, tr, XS, HEAVY)


@query("channel_moments_by_subject", s="channel", i="fold n", f="mean sd", sql="""
    SELECT CAST(subject_id AS BIGINT) % 5 AS fold, channel, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM c_long GROUP BY 1, 2""")
def _(t):
    members = t.subjects.select("subject_id", (F.col("subject_id").cast("bigint") % 5).alias("fold"))
    return R.fold_moments(R.subject_moments(t.long, "subject_id", "channel", "value"), members, "subject_id", "channel", "fold")


@query("fit_scope_record", i="n_fitted digest n_scored_and_fitted", sql="""
    SELECT count(*) AS n_fitted, bit_xor(('0x' || substr(md5(subject_id), 1, 15))::BIGINT) AS digest, (SELECT count(*) FROM c_cust WHERE fold <> 0 AND y3 = 1) AS n_scored_and_fitted FROM c_cust WHERE fold <> 0""")
def _(t):
    return R.scope_record(t.customers.where("fold <> 0"), t.customers.where("y3 = 1"), "subject_id")
