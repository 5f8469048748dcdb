"""Contracts, splits, sampling, grids, audits and inference with planted faults."""

import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import audit as A
from diurna.operators import contracts as C
from diurna.operators import dedup as DD
from diurna.operators import inference as I
from diurna.operators import joins as J
from diurna.operators import learners as L
from diurna.operators import payload as P
from diurna.operators import prep
from diurna.operators import resample as R
from diurna.operators import sequences as Q
from diurna.operators import splits as S
from diurna.sources import files


def test_allowlist_refuses_missing_column(spark, tmp_path):
    spark.range(3).write.option("header", True).csv(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="absent"):
        files.read_csv_allowlist(spark, str(tmp_path / "x"), ["id", "email"])


def test_scratch_is_a_fresh_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    a, b = files.scratch(spark, "t"), files.scratch(spark, "t")
    assert a != b and (not base or a.startswith(base))


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_keyed_pseudonym_is_hmac(spark, key):
    got = spark.createDataFrame([("a@b.c",)], "s string").select(C.keyed_pseudonym(F.col("s"), key).alias("h")).first().h
    assert got == hmac.new(key, b"a@b.c", hashlib.sha256).hexdigest()


def test_labels_conflict_and_unknown(spark):
    d = spark.createDataFrame([("a", "CN"), ("a", "CN"), ("b", "CN"), ("b", "MCI"), ("c", "?")], "s string, l string")
    got = {r.s: (r.status, r.code) for r in C.checked_labels(d, "s", "l", {"CN": 0, "MCI": 1}).collect()}
    assert got == {"a": ("ok", 0), "b": ("conflict", None), "c": ("unknown", None)}


def test_longest_episode_tie_is_deterministic(spark):
    d = spark.sql("select * from values ('s', 10, 5, 9), ('s', 10, 3, 8), ('s', 7, 1, 2) as t(k, dur, st, en)")
    r = DD.longest_episode(d, ["k"], "dur", "st", "en").first()
    assert (r.dur, r.st) == (10, 3)


def test_sleep_across_four_oclock_spills_into_both_days(spark):
    series = spark.createDataFrame([], "subject_id string, date date, pos int, channel string, value double")
    iv = spark.sql("select 's' subject_id, timestamp_ntz'2024-01-02 03:30:00' start_ts, timestamp_ntz'2024-01-02 04:15:00' end_ts, 'sleep' channel, 1.0D value")
    g = J.minute_grid(series, iv).groupBy("date").agg(F.min("minute").alias("a"), F.max("minute").alias("b")).orderBy("date").collect()
    assert [(str(r.date), r.a, r.b) for r in g] == [("2024-01-01", 1410, 1439), ("2024-01-02", 0, 14)]


def test_later_interval_wins(spark):
    series = spark.createDataFrame([], "subject_id string, date date, pos int, channel string, value double")
    iv = spark.sql("""select * from values ('s', timestamp_ntz'2024-01-02 10:00:00', timestamp_ntz'2024-01-02 10:10:00', 'sleep', 1.0D),
        ('s', timestamp_ntz'2024-01-02 10:05:00', timestamp_ntz'2024-01-02 10:20:00', 'sleep', 2.0D) as t(subject_id, start_ts, end_ts, channel, value)""")
    got = {r.minute: r.value for r in J.minute_grid(series, iv).collect()}
    assert got[364] == 1.0 and got[365] == 2.0 and len(got) == 20


def days(spark, n=30, skip=()):
    return spark.range(n).where(~F.col("id").isin(*skip) if skip else F.lit(True)).select(
        F.lit("s").alias("subject_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))


def test_windows_stay_inside_runs(spark):
    d = days(spark, 12, (5,))
    strict = Q.windows(d, "subject_id", "date", "row_id", ["x"], 3)
    assert strict.where("is_consecutive = 0").count() == 0 and strict.count() == 3 + 4
    glued = Q.windows(d, "subject_id", "date", "row_id", ["x"], 3, consecutive=False)
    assert glued.count() == 9 and glued.where("is_consecutive = 0").count() == 2
    assert Q.windows(d, "subject_id", "date", "row_id", ["x"], 3, stride=2).count() < strict.count()


def test_embargo_keeps_windows_apart(spark):
    r = S.final_week(days(spark), "subject_id", "date", "calendar_days", 7, embargo=2, validation=3)
    n = {x.role: x["count"] for x in r.groupBy("role").count().collect()}
    assert n == {"test": 7, "embargo": 2, "validation": 3, "train": 18}
    log = {x.check_name: x.passed for x in A.temporal_order(r.where("role = 'train'"), r.where("role = 'test'"), "subject_id", "date", 2).collect()}
    assert log == {"train_before_test": 1, "embargo": 1}


def test_every_subject_held_out_once_per_repeat(spark):
    d = spark.range(103).select(F.col("id").cast("string").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    f = S.repeated_kfold(d, "s", "y", 5, 4, 3)
    assert f.groupBy("repeat", "s").count().where("count <> 1").count() == 0
    sizes = [r["count"] for r in f.groupBy("repeat", "fold", "y").count().collect()]
    assert max(sizes) - min(s for s in sizes if s > 10) <= 1 or len(set(sizes)) <= 4
    assert S.viability(f, ["repeat", "fold"], "y").where("viable = 0").count() == 0


def quotas_by_hand(counts, keep):
    """The allocation rule with an explicit loop; returns the sorted quotas."""
    total = sum(counts)
    exact = [c * keep / total for c in counts]
    alloc = [max(1, math.floor(e)) for e in exact]
    left = keep - sum(alloc)
    for i in sorted(range(len(counts)), key=lambda i: -(exact[i] - math.floor(exact[i]))):
        if left > 0 and alloc[i] < counts[i]:
            alloc[i] += 1
            left -= 1
    while left < 0 and max(alloc) > 1:
        alloc[alloc.index(max(alloc))] -= 1
        left += 1
    return sorted(alloc)


@pytest.mark.parametrize("minority", [60, 34, 150, 20])
def test_subject_quotas(spark, minority):
    """Hot subject, many tiny ones: remainder, levelling and fewer-rows-than-subjects branches."""
    counts = [90, 25, 12] + [1] * 29
    rows = [(f"m{i}", 1, 1000 * i + k) for i, c in enumerate(counts) for k in range(c)] + [(f"n{k}", 0, 10 ** 6 + k) for k in range(minority)]
    d = spark.createDataFrame(rows, "s string, y int, id long")
    q = sorted(r.quota for r in R.subject_quotas(d, "s", "y", 1.0, 5).collect())
    if minority >= sum(counts):
        assert q == sorted(counts)
    elif minority <= len(counts):
        assert sum(q) == minority and set(q) <= {0, 1}
    else:
        assert q == quotas_by_hand(counts, minority) and sum(q) == minority
    kept = R.undersample_balanced(d, "s", "id", "y", 1.0, 5)
    assert kept.where("y = 1").count() == sum(q) and kept.where("y = 0").count() == minority


def test_bootstrap_draws_keep_size(spark):
    d = spark.range(200).select(F.col("id").cast("string").alias("s"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    w = R.bootstrap_weights(d, "s", 6, 1)
    assert [r.n for r in w.groupBy("draw").agg(F.sum("weight").alias("n")).collect()] == [200] * 6
    st = R.bootstrap_weights(d, "s", 6, 1, ["y"]).groupBy("draw", "y").agg(F.sum("weight").alias("n")).collect()
    assert {(r.y, r.n) for r in st} == {(0, 150), (1, 50)}


def test_smote_reaches_parity_and_adds_minority_only(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 12), *map(float, rng.normal(size=2))) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double")
    s = R.smote(d, ["a", "b"], "id", "y")
    assert s.count() == 38 - 12
    assert s.where("source_id >= 12 or partner_id >= 12 or source_id = partner_id").count() == 0


def test_fit_uses_train_rows_only(spark):
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 1000.0), (1, None)], "fold int, x double")
    got = sorted(r.x for r in prep.median_impute(d, d.where("fold = 0"), ["x"]).collect())
    assert got == [1.0, 2.0, 3.0, 1000.0]


def test_minmax_keeps_missing_and_padding(spark):
    d = spark.createDataFrame([(0.0,), (4.0,), (None,), (-1.0,), (9.0,)], "x double")
    got = [r.x for r in prep.minmax_scale(d, d.where("x < 5 or x is null"), ["x"]).collect()]
    assert got == [0.0, 1.0, None, -1.0, 1.0]
    none = [r.x for r in prep.minmax_scale(d, d.where("x is null"), ["x"]).collect()]
    assert none == [0.0, 0.0, None, -1.0, 0.0]


def test_audit_fires_on_planted_overlap(spark):
    d = days(spark).withColumn("y", F.lit(1))
    log = {r.check_name: (r.passed, r.detail) for r in A.split(d.where("row_id < 20"), d.where("row_id >= 18"), "subject_id", "row_id", "date", d, d.limit(0)).collect()}
    assert log["row_overlap"] == (0, "2") and log["subject_date_overlap"] == (0, "2")
    assert log["sampling_scope_excludes_test"][0] == 1 and log["fit_scope_excludes_test"][0] == 0


def test_frozen_digest_notices_a_change(spark):
    d = days(spark)
    assert A.frozen(d, d.repartition(5), ["row_id", "x"]).first().unchanged == 1
    changed = d.withColumn("x", F.when(F.col("row_id") == 3, 99.0).otherwise(F.col("x")))
    assert A.frozen(d, changed, ["row_id", "x"]).first().unchanged == 0


def test_t_tail(spark):
    # two-sided quantiles: P(|T| >= q) = 0.05
    rows = [(2.228139, 10.0), (-2.042272, 30.0), (12.706205, 1.0), (0.0, 7.0), (None, 3.0)]
    p = [r.p for r in spark.createDataFrame(rows, "t double, df double").select(I.two_sided_t_p("t", "df").alias("p")).collect()]
    assert p[:4] == pytest.approx([0.05, 0.05, 0.05, 1.0], abs=2e-6)
    assert p[4] is None or math.isnan(p[4])


def test_permuted_labels_give_auc_near_half(spark):
    d = spark.range(600).select(F.col("id").cast("string").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("score"))
    null = I.permutation_auc(d, [], "s", "score", "y", 12, 5)
    assert abs(null.agg(F.avg("auc")).first()[0] - 0.5) < 0.03


def test_random_intercept_recovers_effect(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        u = rng.normal(0, 1.0)
        rows += [(str(i), i % 2, float(2.0 * (i % 2) + u + rng.normal(0, 1.0))) for _ in range(3 + i % 5)]
    r = I.random_intercept(spark.createDataFrame(rows, "s string, g int, v double"), "s", "g", "v").first()
    assert abs(r.beta - 2.0) < 0.6 and r.z > 5 and 0.3 <= r.ratio <= 2.0 and r.p < 1e-6


def reml(rows, ratio):
    """The restricted likelihood with whole covariance matrices."""
    s, g, y = (np.array(c) for c in zip(*rows, strict=True))
    x = np.column_stack([np.ones(len(y)), g])
    v = np.eye(len(y)) + ratio * (s[:, None] == s[None, :])
    i = np.linalg.inv(v)
    a = x.T @ i @ x
    beta = np.linalg.solve(a, x.T @ i @ y)
    r = y - x @ beta
    s2 = r @ i @ r / (len(y) - 2)
    return -0.5 * ((len(y) - 2) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta[1], np.sqrt(s2 * np.linalg.inv(a)[1, 1])


@pytest.mark.parametrize("spread", [1.2, 0.4, 0.0])
def test_random_intercept_is_at_the_optimum(spark, spread):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(40):
        u = rng.normal(0, spread)
        rows += [(f"s{k}", k % 2, 100.0 + 0.7 * (k % 2) + u + float(rng.normal())) for _ in range(1 + k % 6)]
    d = spark.createDataFrame([*rows, ("s0", 0, None), ("s1", 1, float("nan"))], "s string, g int, v double")
    r = I.random_intercept(d, "s", "g", "v").first()
    best, beta, se = reml(rows, r.ratio)
    assert (r.criterion, r.beta, r.se) == pytest.approx((best, beta, se), rel=1e-9)
    for step in (1e-3, 0.05, 1.0):
        assert all(reml(rows, r.ratio + x)[0] <= best + 1e-12 for x in (step, -step) if r.ratio + x >= 0)
    slope = I.restricted_likelihood(I.intercept_cells(d, "s", "g", "v"), r.ratio)
    assert r.ratio == 0 and slope["slope"] <= 0 or abs(slope["slope"] / slope["curve"]) < 1e-8 * r.ratio
    assert r.p == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)))


def test_random_intercept_of_one_group_has_no_row(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 4.0)], "s string, g int, v double")
    assert I.random_intercept(d, "s", "g", "v").count() == 0 and I.random_intercept(d.limit(0), "s", "g", "v").count() == 0


def test_leave_out_cells_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    t, a, b = (rng.integers(0, 3, 25) for _ in range(3))

    def f1(idx, p):
        out = []
        for k in range(3):
            tp = sum(t[i] == k and p[i] == k for i in idx)
            den = sum(t[i] == k for i in idx) + sum(p[i] == k for i in idx)
            out.append(2 * tp / den if den else 0.0)
        return float(np.mean(out))

    d = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(t, a, b)], "t int, a int, b int")
    got = {r.removed: r for r in I.leave_out_deltas(d, "t", "a", "b").collect()}
    full = set(range(25))
    one = [f1(full - {i}, a) - f1(full - {i}, b) for i in full]
    two = [f1(full - {i, j}, a) - f1(full - {i, j}, b) for i in full for j in full if i < j]
    assert got[1].evaluations == 25 and got[2].evaluations == len(two)
    assert got[1].min_delta == pytest.approx(min(one)) and got[2].min_delta == pytest.approx(min(two))
    assert got[2].positive_fraction == pytest.approx(np.mean(np.array(two) > 1e-12), abs=0.02)


def test_program_is_validated():
    bad = '{"features": [{"name": "f", "operation": "signed_mean", "dependencies": ["zz"], "directions": [1]}]}'
    with pytest.raises(ValueError):
        P.compile_program(bad, ["x1"])


def test_privacy_scan_finds_a_raw_id(spark):
    texts = spark.createDataFrame([("a", "score of user-7 is 1"), ("b", "nothing here")], "src string, txt string")
    ids = spark.createDataFrame([("user-7",), ("user-8",)], "sid string")
    assert [(r.src, r.ids_found) for r in A.privacy(texts, "txt", "src", ids, "sid").orderBy("src").collect()] == [("a", 1), ("b", 0)]
