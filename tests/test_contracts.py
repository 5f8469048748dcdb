"""Readers by name, digests, audits and quantiles on cases that once went wrong."""

import hashlib

import pytest
from pyspark.sql import functions as F

from diurna.operators import audit, contracts, inference, ranking
from diurna.sources import files


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,email,note\n1,x,"two\nlines"\n')
    (tmp_path / "b.csv").write_text('﻿email,id\nz,3\n', encoding="utf-8")
    got = files.read_csv_allowlist(spark, str(tmp_path), ["id", "email"], ["note"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", "x", "two\nlines"), ("3", "z", None)]
    with pytest.raises(ValueError, match="absent"):
        files.read_csv_allowlist(spark, str(tmp_path), ["id", "note"])


def test_encodings_are_found_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,label\n1,서울\n".encode())
    (tmp_path / "b.csv").write_bytes("label,id\n부산,2\n".encode("cp949"))
    got = files.read_csv_fallback(spark, str(tmp_path), ["id", "label"])
    assert sorted(map(tuple, got.collect())) == [("1", "서울", "utf-8"), ("2", "부산", "MS949")]


def test_any_csv_if_no_name_fits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y_sleep.csv").write_text("b,a\n3,4\n")
    assert [(r.a, r.b) for r in files.read_by_stem(spark, str(tmp_path), "sleep").collect()] == [("4", "3")]
    assert sorted((r.a, r.b) for r in files.read_by_stem(spark, str(tmp_path), "steps").collect()) == [("1", "2"), ("4", "3")]


def test_file_digest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc" * 10_000)
    assert files.fingerprint_files(spark, str(tmp_path), block=1000).first().sha256 == hashlib.sha256(b"abc" * 10_000).hexdigest()


def test_equal_rows_do_not_cancel(spark):
    def digest(rows, names="x string, y string"):
        return tuple(contracts.frame_fingerprint(spark.createDataFrame(rows, names), [n.split()[0] for n in names.split(", ")]).first())

    assert digest([("a", "b"), ("a", "b")]) != digest([("c", "d"), ("c", "d")])
    assert digest([("a|b", "c")]) != digest([("a", "b|c")]) and digest([(None, "")]) != digest([("", None)])
    assert digest([("a", "b")]) != digest([("a", "b")], "x string, z string")
    assert digest([("a", "b"), ("c", "d")]) == digest([("c", "d"), ("a", "b")])


def test_frozen_sees_a_changed_score(spark):
    a = spark.createDataFrame([("s", 0.5), ("t", 0.25)], "subject string, score double")
    b = a.withColumn("score", F.when(F.col("subject") == "t", 0.26).otherwise(F.col("score")))
    assert audit.frozen(a, a, ["subject", "score"]).first().unchanged == 1
    assert audit.frozen(a, b, ["subject", "score"]).first().unchanged == 0


def test_ids_at_the_edge_of_words(spark):
    texts = spark.createDataFrame([("bad", "seen user-1."), ("worse", "to: x@user-2, ok"), ("good", "user-10 user")], "source string, text string")
    ids = spark.createDataFrame([("user-1",), ("user-2",)], "sid string")
    assert {r.source: r.ids_found for r in audit.privacy(texts, "text", "source", ids, "sid").collect()} == {"bad": 1, "worse": 1, "good": 0}


def test_nan_is_left_out_of_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("nan"), None)], "v double")
    assert ranking.quantiles(df, [], "v", [0.5]).first().q50 == 2.0


@pytest.mark.parametrize(("df", "want"), [(1, 12.706204736), (5, 2.570581836), (31, 2.039513446), (40, 2.021075390), (60, 2.000297822), (1e6, 1.959966)])
def test_t_quantile(spark, df, want):
    got = spark.range(1).select(inference.t_quantile(F.lit(0.975), F.lit(float(df))).alias("q")).first().q
    assert abs(got - want) < 1e-6


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    old, files._LOCAL = files._LOCAL, {}
    try:
        with pytest.raises(ValueError, match="checkpoint"):
            files.scratch(Fake, "x")
    finally:
        files._LOCAL = old
