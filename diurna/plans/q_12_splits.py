"""Splits, sampling, resampling and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from diurna.operators import resample as R
from diurna.operators import splits as S
from diurna.operators.draws import FACTOR, GOLDEN, ROUNDS, permuted, poisson_steps
from diurna.plans.carrier_sql import h
from diurna.plans.registry import query
from diurna.sources.carriers import FEATURES

XS = list(FEATURES)
ALL = " ".join(XS)


def hx(*parts: str) -> str:
    return "md5(concat_ws('-', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


@query("stratified_kfold", s="subject_id", i="y fold", sql=f"SELECT subject_id, y, (row_number() OVER (PARTITION BY y ORDER BY {hx('7', 'subject_id')}, subject_id) - 1) % 5 AS fold FROM c_cust")
def _(t):
    return S.stratified_kfold(t.customers.select("subject_id", "y"), "subject_id", "y", 5, 7)


REP = f"SELECT subject_id, y, repeat, (row_number() OVER (PARTITION BY repeat, y ORDER BY {hx('7 + 1009 * repeat', 'subject_id')}, subject_id) - 1) % 5 AS fold FROM c_cust, (SELECT unnest(range(3)) AS repeat)"


@query("repeated_kfold", s="subject_id", i="y repeat fold", sql=REP)
def _(t):
    return S.repeated_kfold(t.customers.select("subject_id", "y"), "subject_id", "y", 5, 3, 7, 1009)


@query("nested_inner_folds", s="subject_id", i="y outer_fold inner_fold", sql=f"""
    SELECT subject_id, y, o AS outer_fold, (row_number() OVER (PARTITION BY o, y ORDER BY {hx('11 + o', 'subject_id')}, subject_id) - 1) % 4 AS inner_fold FROM c_cust, (SELECT unnest(range(5)) AS o) WHERE fold <> o""")
def _(t):
    return S.inner_folds(t.customers.select("subject_id", "y", "fold"), "subject_id", "y", "fold", 5, 4, 11)


@query("adaptive_k", i="smallest k", sql="SELECT min(c) AS smallest, least(400, greatest(2, min(c) // 3)) AS k FROM (SELECT y3, count(*) AS c FROM c_cust GROUP BY 1)")
def _(t):
    return S.adaptive_k(t.customers, "y3", 400, 3)


@query("row_level_split", i="n_train n_test subjects_on_both", sql=f"""
    WITH s AS (SELECT subject_id, row_number() OVER (ORDER BY {hx('5', 'window_id')}, window_id) <= floor(count(*) OVER () * 0.2) AS te FROM c_ord),
    g AS (SELECT subject_id, count(*) FILTER (WHERE NOT te) AS a, count(*) FILTER (WHERE te) AS b FROM s GROUP BY 1)
    SELECT sum(a) AS n_train, sum(b) AS n_test, count(*) FILTER (WHERE a > 0 AND b > 0) AS subjects_on_both FROM g""")
def _(t):
    return S.sides_report(S.hash_holdout(t.order_scores, "window_id", 0.2, 5), "subject_id")


@query("subject_holdout", s="subject_id side", sql=f"""
    SELECT subject_id, CASE WHEN row_number() OVER (ORDER BY {hx('5', 'subject_id')}, subject_id) <= floor(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS side FROM c_cust""")
def _(t):
    return S.hash_holdout(t.customers, "subject_id", 0.2, 5)


@query("official_partition", s="subject_id side", sql="SELECT subject_id, CASE WHEN fold < 4 THEN 'train' ELSE 'test' END AS side FROM c_cust")
def _(t):
    d = t.customers.withColumn("split_origin", F.when(F.col("fold") < 4, "train").otherwise("validation"))
    return d.withColumn("side", S.official(d, "split_origin"))


def week_sql(mode: str, cut: str) -> str:
    return (f"SELECT '{mode}' AS mode, subject_id, date, CASE WHEN date >= cut THEN 'test' WHEN date >= cut - 2 THEN 'embargo' WHEN date >= lastd - 2 THEN 'validation' ELSE 'train' END AS role "
            f"FROM (SELECT *, max(date) FILTER (WHERE date < cut - 2) OVER (PARTITION BY subject_id) AS lastd FROM (SELECT subject_id, date, {cut} AS cut FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) AS back FROM c_slp)))")


@query("final_week_split", s="mode subject_id date role", sql=week_sql("calendar_days", "max(date) OVER (PARTITION BY subject_id) - 6") + " UNION ALL "
       + week_sql("record_count", "min(date) FILTER (WHERE back <= 7) OVER (PARTITION BY subject_id)"))
def _(t):
    a, b = (S.final_week(t.sleep, "subject_id", "date", m, 7, 2, 3).select(F.lit(m).alias("mode"), "subject_id", "date", "role") for m in ("calendar_days", "record_count"))
    return a.unionAll(b)


@query("split_viability", i="repeat fold n n_pos n_neg viable", sql=f"SELECT repeat, fold, count(*) AS n, sum(y) AS n_pos, count(*) - sum(y) AS n_neg, least(sum(y), count(*) - sum(y)) >= 1 AS viable FROM ({REP}) GROUP BY 1, 2")
def _(t):
    return S.viability(S.repeated_kfold(t.customers.select("subject_id", "y"), "subject_id", "y", 5, 3, 7, 1009), ["repeat", "fold"], "y")


UND = f"""SELECT subject_id, window_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hx('3', 'window_id')}, window_id) AS rn, sum(1 - y) OVER () AS nmin FROM c_ord) WHERE y = 0 OR rn <= nmin"""


@query("undersample_random", s="subject_id", i="window_id y", sql=UND)
def _(t):
    return R.undersample_random(t.order_scores, "window_id", "y", 1.0, 3)


QUOTA = """q0 AS (SELECT subject_id, count(*) AS c, (SELECT sum(1 - y) FROM c_ord) AS keep, (SELECT sum(y) FROM c_ord) AS tot FROM c_ord WHERE y = 1 GROUP BY 1),
    q1 AS (SELECT *, c * keep / tot::DOUBLE - floor(c * keep / tot::DOUBLE) AS fr, greatest(1, CAST(floor(c * keep / tot::DOUBLE) AS BIGINT)) AS alloc FROM q0),
    q2 AS (SELECT *, keep - sum(alloc) OVER () AS rem, CASE WHEN alloc < c THEN row_number() OVER (PARTITION BY alloc < c ORDER BY fr DESC, md5(subject_id)) END AS ord FROM q1),
    qq AS (SELECT subject_id, c, alloc + CASE WHEN ord <= rem THEN 1 ELSE 0 END AS quota FROM q2)"""


@query("undersample_subject_balanced", s="subject_id", i="window_id y", sql=f"""
    WITH {QUOTA} SELECT o.subject_id, window_id, y FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, y ORDER BY {hx('3', 'window_id')}, window_id) AS rn FROM c_ord) o LEFT JOIN qq ON qq.subject_id = o.subject_id WHERE y = 0 OR rn <= quota""")
def _(t):
    return R.undersample_balanced(t.order_scores, "subject_id", "window_id", "y", 1.0, 3)


@query("sampling_report", i="n_before pos_before n_after pos_after subjects_lost warn_lost warn_dominant warn_removed", f="top_subject_share", sql=f"""
    WITH a AS ({UND}) SELECT (SELECT count(*) FROM c_ord) AS n_before, (SELECT sum(y) FROM c_ord) AS pos_before, count(*) AS n_after, sum(y) AS pos_after,
      (SELECT count(DISTINCT subject_id) FROM c_ord) - count(DISTINCT subject_id) AS subjects_lost, (SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY subject_id)) / count(*)::DOUBLE AS top_subject_share,
      (SELECT count(DISTINCT subject_id) FROM c_ord) > count(DISTINCT subject_id) AS warn_lost, (SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY subject_id)) / count(*)::DOUBLE > 0.1 AS warn_dominant,
      sum(y) / (SELECT sum(y) FROM c_ord)::DOUBLE < 0.4 AS warn_removed FROM a""")
def _(t):
    return R.sampling_report(t.order_scores, R.undersample_random(t.order_scores, "window_id", "y", 1.0, 3), "subject_id", "y")


# In the vectors the minority class is y3 = 2 against the rest.
VMIN = """mi AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS idx, count(*) OVER () AS n FROM c_vec WHERE y3 = 2),
    sl AS (SELECT unnest(range((SELECT count(*) FILTER (WHERE y3 <> 2) - count(*) FILTER (WHERE y3 = 2) FROM c_vec))) AS slot)"""


def vec(t):
    return t.vectors.withColumn("target", (F.col("y3") == 2).cast("int"))


@query("oversample_random", i="slot source_id", sql=f"WITH {VMIN} SELECT slot, vec_id AS source_id FROM sl JOIN mi ON mi.idx = {h('21', 'slot')} % (SELECT count(*) FROM mi)")
def _(t):
    return R.oversample_random(vec(t), "vec_id", "target", 21)


def knn(q: str, r: str, k: int, name: str, cols=XS) -> str:
    """All pairs in SQL: the check is brute force on purpose."""
    d = " + ".join(f"pow(q.{c} - r.{c}, 2)" for c in cols)
    return (f"{name} AS (SELECT qid, rid, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM "
            f"(SELECT q.vec_id AS qid, r.vec_id AS rid, sqrt({d}) AS dist FROM {q} q, {r} r WHERE q.vec_id <> r.vec_id)) WHERE rank <= {k})")


def lerp(seed: int, slots: str, nn: str) -> str:
    lam = f"({h(str(seed), repr('l'), 'slot')} / 4294967296.0::DOUBLE)"
    return (f"SELECT slot, s.source_id, a.vec_id AS a_id, b.vec_id AS partner_id, {', '.join(f'a.{c} + {lam} * (b.{c} - a.{c}) AS {c}' for c in XS)} FROM {slots} s "
            f"JOIN {nn} n ON n.qid = s.source_id AND n.rank = {h(str(seed), repr('n'), 'slot')} % (SELECT max(rank) FROM {nn} z WHERE z.qid = s.source_id) + 1 JOIN c_vec a ON a.vec_id = s.source_id JOIN c_vec b ON b.vec_id = n.rid")


def source(seed: int, src: str) -> str:
    return f"(SELECT slot, vec_id AS source_id FROM sl JOIN {src} ON {src}.idx = {h(str(seed), repr('i'), 'slot')} % (SELECT count(*) FROM {src}))"


ZED = f"z AS (SELECT vec_id, y3, {', '.join(f'({c} - m{c}) / s{c} AS {c}' for c in XS)} FROM c_vec, (SELECT {', '.join(f'avg({c}) AS m{c}, stddev_pop({c}) AS s{c}' for c in XS)} FROM c_vec)), zm AS (SELECT * FROM z WHERE y3 = 2)"
SHARE = f"{knn('zm', 'z', 5, 'na')}, sh AS (SELECT qid, avg((c.y3 <> 2)::INT) AS share FROM na JOIN c_vec c ON c.vec_id = na.rid GROUP BY 1)"


@query("smote", s="space", i="slot source_id partner_id", f=ALL, sql=f"""
    WITH {VMIN}, {ZED}, {knn('mi', 'mi', 5, 'nn')}, {knn('zm', 'zm', 5, 'nz')}, so AS {source(4, 'mi')}
    SELECT 'raw' AS space, * FROM ({lerp(4, 'so', 'nn')}) UNION ALL SELECT 'standardised', * FROM ({lerp(4, 'so', 'nz')})""")
def _(t):
    raw, scaled = (R.smote(vec(t), XS, "vec_id", "target", 5, 4, standardise=z) for z in (False, True))
    return raw.withColumn("space", F.lit("raw")).unionByName(scaled.withColumn("space", F.lit("standardised")))


@query("borderline_smote", i="slot source_id partner_id", f=ALL, sql=f"""
    WITH {VMIN}, {ZED}, {SHARE}, dg AS (SELECT *, (share >= 0.5 AND share < 1)::INT AS d FROM sh), sd AS (SELECT m.*, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS idx FROM c_vec m JOIN dg ON dg.qid = m.vec_id WHERE d = 1 OR (SELECT sum(d) FROM dg) < 2),
    zs AS (SELECT z.* FROM z JOIN sd ON sd.vec_id = z.vec_id), {knn('zs', 'zs', 5, 'nn')}, so AS {source(4, 'sd')} {lerp(4, 'so', 'nn')}""")
def _(t):
    return R.borderline_smote(vec(t), XS, "vec_id", "target", 5, 4)


@query("adasyn", s="slot", i="source_id partner_id", f=ALL, sql=f"""
    WITH {VMIN}, {ZED}, {SHARE}, g AS (SELECT qid, CAST(round_even(share / (SELECT sum(share) FROM sh) * (SELECT count(*) FROM sl), 0) AS BIGINT) AS g FROM sh),
    so AS (SELECT source_id, source_id || '-' || j AS slot FROM (SELECT qid AS source_id, unnest(range(1, g + 1)) AS j FROM g)), {knn('zm', 'zm', 5, 'nn')} {lerp(4, 'so', 'nn')}""")
def _(t):
    return R.adasyn(vec(t), XS, "vec_id", "target", 5, 4)


@query("smote_tomek", i="vec_id target", f=ALL, sql=f"""
    WITH {VMIN}, {knn('mi', 'mi', 5, 'nn')}, so AS {source(4, 'mi')}, sm AS ({lerp(4, 'so', 'nn')}),
    al AS (SELECT vec_id, (y3 = 2)::INT AS target, {', '.join(XS)} FROM c_vec UNION ALL SELECT -slot - 1, 1, {', '.join(XS)} FROM sm), {knn('al', 'al', 1, 'n1')},
    tl AS (SELECT a.qid, a.rid FROM n1 a JOIN n1 b ON a.qid = b.rid AND a.rid = b.qid JOIN al p ON p.vec_id = a.qid JOIN al r ON r.vec_id = a.rid WHERE p.target <> r.target)
    SELECT * FROM al WHERE vec_id NOT IN (SELECT qid FROM tl)""")
def _(t):
    return R.smote_tomek(vec(t), XS, "vec_id", "target", 5, 4)


POSITIVE = XS[::3]
RAISED = {c: f"greatest(s.{c}, 0)" if c in POSITIVE else f"s.{c}" for c in XS}


@query("synthetic_postprocess", i="vec_id n_negative n_below n_above", f=ALL, sql=f"""
    WITH p AS (SELECT {', '.join(f'min({c}) AS l_{c}, max({c}) AS h_{c}' for c in XS)} FROM c_vec WHERE fold <> 0), s AS (SELECT vec_id, {', '.join(f'{c} * 1.5 AS {c}' for c in XS)} FROM c_vec)
    SELECT vec_id, {', '.join(f'greatest(least({RAISED[c]}, h_{c}), l_{c}) AS {c}' for c in XS)}, {' + '.join(f'(s.{c} < 0)::INT' for c in POSITIVE)} AS n_negative,
      {' + '.join(f'({RAISED[c]} < l_{c})::INT' for c in XS)} AS n_below, {' + '.join(f'({RAISED[c]} > h_{c})::INT' for c in XS)} AS n_above FROM s, p""")
def _(t):
    s = t.vectors.select("vec_id", *[(F.col(x) * 1.5).alias(x) for x in XS])
    return R.postprocess_synthetic(s, t.vectors.where("fold <> 0"), XS, POSITIVE)


@query("synthetic_provenance", s="generator", i="slot source_id gen_seed source_class is_synthetic source_digest source_subjects", sql=f"""
    WITH {VMIN} SELECT slot, vec_id AS source_id, 'random' AS generator, 21 AS gen_seed, 1 AS source_class, 1 AS is_synthetic,
      (SELECT bit_xor(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 15))::BIGINT) FROM c_vec) AS source_digest, (SELECT count(*) FROM c_vec) AS source_subjects FROM sl JOIN mi ON mi.idx = {h('21', 'slot')} % (SELECT count(*) FROM mi)""")
def _(t):
    return R.with_provenance(R.oversample_random(vec(t), "vec_id", "target", 21), t.vectors, "vec_id", "random", 21, F.lit(1))


@query("class_weights_balanced", s="variant", i="y3 n", f="weight", sql="""
    WITH c AS (SELECT y3, count(*) AS n, sum(count(*)) OVER () / (3.0::DOUBLE * count(*)) AS w FROM c_cust GROUP BY 1)
    SELECT 'balanced' AS variant, y3, n, w AS weight FROM c UNION ALL SELECT 'power', y3, n, sqrt(w) / (SELECT avg(sqrt(w)) FROM c) FROM c""")
def _(t):
    return R.class_weights(t.customers, "y3").withColumn("variant", F.lit("balanced")).unionByName(
        R.class_weights(t.customers, "y3", 0.5).withColumn("variant", F.lit("power")))


@query("subject_balanced_weights", s="subject_id", i="y rows", f="weight", sql="""
    WITH s AS (SELECT subject_id, max(y) AS y, count(*) AS r FROM c_ord GROUP BY 1), w AS (SELECT *, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) / r AS raw FROM s)
    SELECT subject_id, y, r AS rows, raw * (SELECT sum(r) / sum(raw * r) FROM w) AS weight FROM w""")
def _(t):
    return R.subject_balanced_weights(t.order_scores, "subject_id", "y")


def boot_sql(seed: int, draws: int, by: str | None, src: str = "c_cust") -> str:
    part = f"PARTITION BY {by}" if by else ""
    tag = by if by else "'all'"
    keys = f"AND b.{by} = p.{by}" if by else ""
    return (f"WITH b AS (SELECT subject_id, y, row_number() OVER ({part} ORDER BY md5(subject_id), subject_id) - 1 AS idx, count(*) OVER ({part}) AS n FROM {src}), "
            f"p AS (SELECT draw, {by + ',' if by else ''} {h(str(seed), tag, 'draw', 'idx')} % n AS pick, count(*) AS weight FROM b, (SELECT unnest(range({draws})) AS draw) GROUP BY ALL) "
            f"SELECT draw, subject_id, weight, b.y FROM p JOIN b ON b.idx = p.pick {keys}")


@query("bootstrap_subject_draws", s="kind subject_id", i="draw weight", sql=f"""
    SELECT 'plain' AS kind, draw, subject_id, weight FROM ({boot_sql(31, 5, None)}) UNION ALL SELECT 'stratified', draw, subject_id, weight FROM ({boot_sql(31, 5, 'y')})""")
def _(t):
    a = R.bootstrap_weights(t.customers, "subject_id", 5, 31).select(F.lit("plain").alias("kind"), "draw", "subject_id", "weight")
    return a.unionAll(R.bootstrap_weights(t.customers, "subject_id", 5, 31, ["y"]).select(F.lit("stratified"), "draw", "subject_id", "weight"))


def mixed_sql(x: str, name: str) -> str:
    """Columns that scramble the 32-bit value x; the last is ``name``."""
    return (f"{x} AS {name}_0, (xor({name}_0, {name}_0 >> 16) * {FACTOR}) & 4294967295 AS {name}_1, "
            f"(xor({name}_1, {name}_1 >> 16) * {FACTOR}) & 4294967295 AS {name}_2, xor({name}_2, {name}_2 >> 16) AS {name}")


def weight_sql(seed: int, draws: int, src: str, unit: str = "subject_id", steps=None) -> str:
    """(unit, draw, weight): the weights of ``draws.draw_weights``, without rows of weight 0."""
    h1, h2 = (f"('0x' || substr(md5(concat_ws('-', '{seed}', CAST({unit} AS VARCHAR))), {at}, 8))::BIGINT" for at in (1, 9))
    weight = " + ".join(f"(u >= {s})::INT" for s in steps or poisson_steps())
    return (f"SELECT {unit}, draw, {weight} AS weight FROM (SELECT {unit}, draw, {mixed_sql(f'(h1 + (draw + 1) * {GOLDEN}) & 4294967295', 'a')}, {mixed_sql('xor(a, h2)', 'b')}, b >> 16 AS u "
            f"FROM (SELECT DISTINCT {unit}, {h1} AS h1, {h2} AS h2 FROM {src}), (SELECT unnest(range({draws})) AS draw)) WHERE u >= {(steps or poisson_steps())[0]}")


def feistel_sql(positions: str, n: int, seed: int) -> str:
    """CTEs ending in ``placed(<columns of positions>, perm, x)``: ``draws.permuted_positions`` of ``positions(spot, n, ...)``."""
    base = f"{mixed_sql(f'{seed}::BIGINT', 's')}, (s + perm * {GOLDEN}) & 4294967295 AS base"
    keys = ", ".join(mixed_sql(f"(base + {r + 1}) & 4294967295", f"k{r}") for r in range(ROUNDS))
    rounds = "x >> bits AS l0, x & mask AS r0"
    for r in range(ROUNDS):
        rounds += f", {mixed_sql(f'(r{r} + k{r}) & 4294967295', f'f{r}')}, r{r} AS l{r + 1}, xor(l{r}, f{r} & mask) AS r{r + 1}"
    names = ", ".join(f"k{r}" for r in range(ROUNDS))
    return (f"ks AS (SELECT perm, {names} FROM (SELECT perm, {base}, {keys} FROM (SELECT unnest(range({n})) AS perm))), "
            f"ps AS (SELECT *, greatest(1, ceil(log2(greatest(n, 2)) / 2))::INT AS bits, (1::BIGINT << bits) - 1 AS mask FROM ({positions})), "
            f"walk AS (SELECT spot, perm, spot::BIGINT AS x, n, bits, mask, {names}, 0 AS turn FROM ps, ks UNION ALL "
            f"SELECT spot, perm, (l{ROUNDS} << bits) + r{ROUNDS} AS x, n, bits, mask, {names}, 1 AS turn FROM (SELECT *, {rounds} FROM walk WHERE turn = 0 OR x >= n)), "
            f"placed AS (SELECT ps.*, w.perm, w.x FROM walk w JOIN ps ON ps.spot = w.spot WHERE w.turn = 1 AND w.x < w.n)")


def perm_sql(cols: str, seed: int, n: int, src: str, unit: str = "subject_id") -> str:
    base = f"SELECT *, row_number() OVER (ORDER BY md5(CAST({unit} AS VARCHAR)), {unit}) - 1 AS spot, count(*) OVER () AS n FROM {src}"
    return f"WITH RECURSIVE {feistel_sql(base, n, seed)} SELECT p.{unit}, p.perm, {', '.join('b.' + c for c in cols.split())} FROM placed p JOIN ps b ON b.spot = p.x"


@query("label_permutation", s="subject_id", i="perm y", sql=perm_sql("y", 41, 20, "c_cust"))
def _(t):
    return permuted(t.customers, "subject_id", ["y"], 20, 41)


@query("column_permutation", i="vec_id perm", f=ALL, sql=perm_sql(ALL, 43, 5, "c_vec", "vec_id"))
def _(t):
    return permuted(t.vectors.select("vec_id", *FEATURES), "vec_id", FEATURES, 5, 43)


@query("prevalence_matched_subsample", i="repeat n n_pos", f="score_sum", sql=f"""
    WITH q AS (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM c_ord),
    d AS (SELECT *, row_number() OVER (PARTITION BY repeat, y ORDER BY {hx('51', 'repeat', 'window_id')}, window_id) AS rn FROM c_ord, (SELECT unnest(range(3)) AS repeat))
    SELECT repeat, count(*) AS n, sum(y) AS n_pos, sum(score) AS score_sum FROM d, q WHERE rn <= CASE WHEN round_even(n1 * ((1 - 0.4::DOUBLE) / 0.4::DOUBLE), 0) <= n0 THEN CASE WHEN y = 1 THEN n1 ELSE round_even(n1 * ((1 - 0.4::DOUBLE) / 0.4::DOUBLE), 0) END
      ELSE CASE WHEN y = 1 THEN least(round_even(n0 * (0.4::DOUBLE / (1 - 0.4::DOUBLE)), 0), n1) ELSE n0 END END GROUP BY 1""")
def _(t):
    d = R.prevalence_matched(t.order_scores, "window_id", "y", 0.4, 3, 51)
    return d.groupBy("repeat").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.sum("score").alias("score_sum"))


