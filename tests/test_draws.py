"""Draw weights, keyed permutations and row ranks against plain numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna.operators import draws as D
from diurna.operators import inference as I
from diurna.operators import ranking as R
from diurna.operators.sequences import reference_ecdf


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(8)
    n = 900
    y = rng.integers(0, 2, n)
    # a third of all rows share one score, others tie now and then, some lack score or label
    score = np.where(rng.random(n) < 1 / 3, 0.5, np.round(rng.random(n) + 0.2 * y, 2))
    rows = [(m, f"s{i // 2}", None if i % 97 == 0 else float(score[i] * (1 if m == "a" else y[i] + 1)), None if i % 89 == 0 else int(y[i])) for i in range(n) for m in "ab"]
    rows += [("one", f"s{i}", float(i), 1) for i in range(30)] + [("nan", "s1", float("nan"), 0)]
    return rows, spark.createDataFrame(rows, "model string, subject string, score double, y int").repartition(5).cache()


def weights(spark, subjects, draws, seed, steps=None):
    d = spark.createDataFrame([(s,) for s in subjects], "subject string").select("subject", *D.unit_hash(seed, "subject")).toPandas()
    return dict(zip(d.subject, D.draw_weights(d._h1.to_numpy(), d._h2.to_numpy(), draws, steps or D.poisson_steps()).astype(int), strict=True))


def brute_auc(s, y, w):
    p, n = y == 1, y == 0
    wins = ((s[p][:, None] > s[n][None, :]) + 0.5 * (s[p][:, None] == s[n][None, :]))
    total = w[p].sum() * w[n].sum()
    return (w[p] @ wins @ w[n]) / total if total else None


@pytest.mark.parametrize(("per_range", "most"), [(10_000, 512), (40, 512), (40, 6), (7, 64)])
def test_auc_of_every_draw(spark, scores, per_range, most):
    rows, table = scores
    got = D.auc_draws(table, ["model"], "subject", "score", "y", 12, 3, per_range=per_range, most=most).toPandas()
    w = weights(spark, {r[1] for r in rows}, 12, 3)
    assert len(got) == 3 * 12
    for m, g in got.groupby("model"):
        use = [r for r in rows if r[0] == m and r[2] is not None and r[2] == r[2] and r[3] is not None]
        s, y = np.array([r[2] for r in use]), np.array([r[3] for r in use])
        for draw, auc in zip(g.draw, g.auc, strict=True):
            want = brute_auc(s, y, np.array([w[r[1]][draw] for r in use]))
            assert (pd.isna(auc) and want is None) or auc == pytest.approx(want, abs=1e-12)
    assert got[got.model == "one"].auc.isna().all()


def test_ranges_do_not_change_the_draws(scores):
    _, table = scores
    a, b = (D.auc_draws(table, ["model"], "subject", "score", "y", 7, 3, per_range=p).toPandas().sort_values(["model", "draw"], ignore_index=True) for p in (30, 5000))
    assert a.equals(b)


def test_a_draw_without_a_class_is_left_out(spark):
    d = spark.createDataFrame([("p", 0.9, 1), ("n", 0.1, 0)], "s string, score double, y int")
    r = I.bootstrap_ci(d.withColumn("m", F.lit("x")), "s", "score", "y", ["m"], 200, 1).first()
    assert 0 < r.n_draws < 200 and r.auc == r.low == r.high == 1.0


def test_sums_of_every_draw(spark, scores):
    rows, table = scores
    got = D.draw_sums(table, ["model"], "subject", {"total": F.col("score"), "n": F.col("score").isNotNull().cast("int")}, 9, 4).toPandas()
    w = weights(spark, {r[1] for r in rows}, 9, 4)
    for r in got[got.model != "nan"].itertuples():
        use = [(x[2], w[x[1]][r.draw]) for x in rows if x[0] == r.model and x[2] is not None]
        assert r.total == pytest.approx(sum(s * k for s, k in use)) and r.n == sum(k for _, k in use)


def test_weights_are_poisson_and_subsamples_have_their_share():
    h = np.random.default_rng(0).integers(0, 2**32, (2, 400))
    w = D.draw_weights(h[0], h[1], 500, D.poisson_steps()).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    s = D.draw_weights(h[0], h[1], 500, D.subsample_steps(0.632))
    assert set(np.unique(s)) == {0, 1} and abs(s.mean() - 0.632) < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 64, 1000, 4096, 4097])
def test_each_permutation_is_a_bijection(n):
    place = D.permuted_positions(np.arange(n)[:, None], np.arange(8)[None, :], n, 5)
    assert (np.sort(place, axis=0) == np.arange(n)[:, None]).all()
    if n >= 1000:
        assert len({tuple(p) for p in place.T.tolist()}) == 8
        assert all(abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.12 for p in place.T)


def test_columns_are_permuted_together(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("s"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    got = D.permuted(d, "s", ["a", "b"], 4, 9).toPandas()
    assert (got.b == 2 * got.a).all() and all(sorted(g.a) == list(range(50)) for _, g in got.groupby("perm"))


def test_null_distribution_is_the_auc_of_permuted_labels(spark, scores):
    _, table = scores
    whole = table.where("model in ('a', 'b') and y is not null").groupBy("model", "subject").agg(F.max("score").alias("score"))
    people = table.where("model = 'a'").groupBy("subject").agg(F.max("y").alias("y"))
    d = whole.join(people, "subject").where("y is not null")
    got = D.permutation_auc(d, ["model"], "subject", "score", "y", 6, 2).toPandas()
    own = d.toPandas()
    per = own.drop_duplicates("subject").copy()
    per["h"] = [hashlib.md5(s.encode()).hexdigest() for s in per.subject]
    per = per.sort_values(["y", "h"], ascending=[False, True], ignore_index=True)
    ones, n = int(per.y.sum()), len(per)
    place = D.permuted_positions(np.arange(n)[:, None], np.arange(6)[None, :], n, 2)
    label = {s: place[i] < ones for i, s in enumerate(per.subject)}
    for r in got.itertuples():
        use = own[(own.model == r.model) & own.score.notna()]
        want = brute_auc(use.score.to_numpy(), np.array([int(label[s][r.perm]) for s in use.subject]), np.ones(len(use)))
        assert r.auc == pytest.approx(want, abs=1e-12)


def test_permutation_p_is_bounded_by_the_number_of_permutations(spark):
    d = spark.range(400).select(F.col("id").cast("string").alias("s"), (F.col("id") >= 200).cast("int").alias("y"), F.col("id").cast("double").alias("score"), F.lit("m").alias("model"))
    r = I.permutation_test(d, ["model"], "s", "score", "y", seed=3).first()
    assert r.observed == 1.0 and r.n == 1000 and r.p == pytest.approx(1 / 1001)


@pytest.mark.parametrize(("per_range", "most"), [(4096, 512), (30, 512), (30, 4)])
def test_row_ranks_with_a_value_of_a_third_of_all_rows(scores, per_range, most):
    _, table = scores
    got = R.row_midranks(table, ["model"], "score", per_range, most).toPandas()
    want = table.where("score is not null and not isnan(score)").toPandas()
    assert len(got) == len(want)
    want["rank"] = want.groupby("model").score.rank()
    key = ["model", "subject", "score", "y"]
    a = got.assign(y=got.y.fillna(-1)).sort_values([*key, "midrank"], ignore_index=True)
    b = want.assign(y=want.y.fillna(-1)).sort_values([*key, "rank"], ignore_index=True)
    assert np.allclose(a.midrank, b["rank"]) and (a.n == a.groupby("model").score.transform("size")).all()


def test_a_frequent_value_is_dealt_to_several_tasks(scores):
    _, table = scores
    d = R.row_ranges(table.where("model = 'a' and score is not null"), [], "score", per_range=20)
    per = d.groupBy("_range").agg(F.count_distinct("score").alias("values"), F.count_distinct("_salt").alias("salts"), F.count("*").alias("n")).toPandas()
    assert (per[per._range % 2 == 1]["values"] == 1).all()
    assert per.loc[per.n.idxmax()].salts >= 8 and per[per.salts == 1].n.max() < 80


def test_ecdf_by_group(spark, scores):
    _, table = scores
    ref, q = table.where("y = 1"), table.where("y = 0").select("model", "subject", "score")
    got = reference_ecdf(ref, q, "score", ["model"]).toPandas()
    base = ref.where("score is not null and not isnan(score)").toPandas()
    for r in got.itertuples():
        own = base[base.model == r.model].score
        if r.score is None or pd.isna(r.score) or not len(own):
            assert pd.isna(r.ecdf)
        else:
            assert r.ecdf == pytest.approx(((own < r.score).sum() + (own <= r.score).sum()) / 2 / len(own))
    assert len(got) == q.count()
