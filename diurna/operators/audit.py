"""Audit logs: rows of (check_name, passed, detail, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.contracts import frame_fingerprint
from diurna.operators.ranking import one_row


def log(df: DataFrame, check: str, passed: Column, detail: Column, severity: str = "critical") -> DataFrame:
    """One row from a one-row aggregate."""
    return df.select(F.lit(check).alias("check_name"), passed.cast("int").alias("passed"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))


def union(logs) -> DataFrame:
    return reduce(DataFrame.unionByName, logs)


def count_is_zero(df: DataFrame, check: str, severity: str = "critical") -> DataFrame:
    """Passes when the frame of violations is empty; the detail is their number."""
    return log(df.agg(F.count("*").alias("c")), check, F.col("c") == 0, F.col("c"), severity)


def dataset(df: DataFrame, subject: str, date: str, row_id: str, label: str, features, expected_columns: int) -> DataFrame:
    dup = df.groupBy(subject, date).agg(F.count("*").alias("c")).where("c > 1")
    ids = df.groupBy(row_id).agg(F.count("*").alias("c")).where("c > 1")
    lab = df.groupBy(subject).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b")
    odd = reduce(lambda a, b: a | b, [F.col(f).isNull() | F.isnan(F.col(f)) | (F.abs(F.col(f)) == float("inf")) for f in features])
    bad = df.agg(F.sum(odd.cast("int")).alias("c"))
    width = df.agg(F.lit(len(features)).alias("c"))
    return union([count_is_zero(dup, "one_row_per_subject_day"), count_is_zero(ids, "unique_row_id"), count_is_zero(lab, "label_constant"),
                  log(bad, "finite_features", F.col("c") == 0, F.col("c"), "warning"), log(width, "expected_columns", F.col("c") == expected_columns, F.col("c"))])


def split(train: DataFrame, test: DataFrame, subject: str, row_id: str, date: str, fitted: DataFrame, sampled: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Overlap of subjects, rows and subject-days; scope of fitting and of sampling; provenance.

    ``made`` lists synthetic train rows with their ``source_id``: each source must be a known row, and none a test row.
    """
    def both(keys):
        return train.select(*keys).distinct().join(test.select(*keys).distinct(), list(keys), "left_semi")

    test_ids = test.select(subject).distinct()
    checks = []
    if made is not None:
        here, there = (d.select(F.col(row_id).alias("source_id")).distinct() for d in (train, test))
        checks = [count_is_zero(made.join(here.unionByName(there).distinct(), "source_id", "left_anti"), "provenance_complete"),
                  count_is_zero(made.join(there, "source_id", "left_semi"), "provenance_excludes_test")]
    return union([
        count_is_zero(both([subject]), "subject_overlap"), count_is_zero(both([row_id]), "row_overlap"), count_is_zero(both([subject, date]), "subject_date_overlap"),
        count_is_zero(fitted.select(subject).distinct().join(test_ids, subject, "left_semi"), "fit_scope_excludes_test"),
        count_is_zero(sampled.select(subject).distinct().join(test_ids, subject, "left_semi"), "sampling_scope_excludes_test"), *checks])


def temporal_order(train: DataFrame, test: DataFrame, subject: str, date: str, min_gap: int) -> DataFrame:
    j = train.groupBy(subject).agg(F.max(date).alias("a")).join(test.groupBy(subject).agg(F.min(date).alias("b")), subject)
    g = j.agg(F.sum((F.col("a") >= F.col("b")).cast("int")).alias("late"), F.min(F.datediff("b", "a") - 1).alias("gap"))
    return union([log(g, "train_before_test", F.col("late") == 0, F.col("late")), log(g, "embargo", F.col("gap") >= min_gap, F.col("gap"))])


def outer_isolation(inner: DataFrame, outer: DataFrame, subject: str) -> DataFrame:
    """Outer-test subjects that occur in the inner folds of the same outer fold, per fold."""
    leaked = inner.select("outer_fold", subject).distinct().join(outer.select("outer_fold", subject), ["outer_fold", subject], "left_semi").groupBy("outer_fold").agg(F.count("*").alias("leaked"))
    return outer.groupBy("outer_fold").agg(F.count("*").alias("n_test")).join(leaked, "outer_fold", "left").select(
        "outer_fold", "n_test", F.coalesce("leaked", F.lit(0)).alias("leaked"), (F.coalesce("leaked", F.lit(0)) == 0).cast("int").alias("passed"))


def duplicate_contents(train: DataFrame, test: DataFrame, content: Column, keep) -> DataFrame:
    """Test windows whose content also occurs in train: hash first, then exact comparison."""
    a = train.select(F.xxhash64(content).alias("_h"), content.alias("_x")).distinct()
    b = test.select(*keep, F.xxhash64(content).alias("_h"), content.alias("_x"))
    return b.join(a, ["_h", "_x"], "left_semi").select(*keep)


def coverage(df: DataFrame, subject: str, keys, repeats: int) -> DataFrame:
    """Subjects without exactly ``repeats`` predictions."""
    return df.groupBy(*keys, subject).agg(F.count("*").alias("n")).where(F.col("n") != repeats)


def frozen(before: DataFrame, after: DataFrame, columns) -> DataFrame:
    """Digest of label-free predictions before and after the labels were opened."""
    a = frame_fingerprint(before, columns).withColumnsRenamed({"digest_a": "a1", "digest_b": "b1", "n_rows": "n1"})
    b = frame_fingerprint(after, columns).withColumnsRenamed({"digest_a": "a2", "digest_b": "b2", "n_rows": "n2"})
    same = (F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2")) & (F.col("n1") == F.col("n2"))
    return a.transform(one_row, b).select("n1", "a1", "b1", same.cast("int").alias("unchanged"))


def identifiers(df: DataFrame, subject: str, date: str, label: str, features) -> DataFrame:
    dup = df.groupBy(subject, date).agg(F.count("*").alias("c")).where("c > 1")
    lab = df.groupBy(subject).agg(F.count_distinct(label).alias("c")).where("c > 1")
    used = df.agg(F.lit(int(subject in features)).alias("c"))
    return union([count_is_zero(dup, "subject_date_duplicates"), count_is_zero(lab, "label_changes"), log(used, "identifier_as_feature", F.col("c") == 0, F.col("c"))])


def same_frames(a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    extra = a.exceptAll(b).unionByName(b.exceptAll(a))
    return count_is_zero(extra, check)


def privacy(texts: DataFrame, text: str, source: str, ids: DataFrame, subject: str) -> DataFrame:
    """Raw ids found as whole words in written text: an equi-join on words, not every text with every id.

    Tokens are also tried without edge punctuation, and in parts cut at it. Clean sources have a row with 0.
    """
    tokens = F.split(F.col(text), "[^A-Za-z0-9_@.#-]+")
    bare = F.transform(tokens, lambda w: F.regexp_replace(w, "^[_@.#-]+|[_@.#-]+$", ""))
    parts = F.split(F.col(text), "[^A-Za-z0-9_-]+")
    words = texts.select(source, F.explode(F.array_distinct(F.concat(tokens, bare, parts))).alias("_w"))
    hits = words.join(ids.select(F.col(subject).alias("_w")).distinct(), "_w").groupBy(source).agg(F.count("*").alias("ids_found"))
    return texts.select(source).distinct().join(hits, source, "left").withColumn("ids_found", F.coalesce("ids_found", F.lit(0)))


def compare_reported(measured: DataFrame, name: str, value: str, reported: dict[str, float]) -> DataFrame:
    """Measured next to reported values with deltas and rank change; rows are the reported models."""
    table = F.create_map(*[F.lit(x) for kv in reported.items() for x in kv])
    d = measured.where(F.col(name).isin(*reported)).select(name, F.try_element_at(table, F.col(name)).alias("reported"), F.col(value).alias("measured"))
    w = Window.partitionBy(F.lit(0))  # one row per reported model
    d = d.withColumns({"reported_rank": F.rank().over(w.orderBy(F.col("reported").desc())), "measured_rank": F.rank().over(w.orderBy(F.col("measured").desc()))})
    return d.withColumns({"delta": F.col("measured") - F.col("reported"), "rank_change": F.col("reported_rank") - F.col("measured_rank")})
