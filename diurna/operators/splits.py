"""Leakage-safe splits as functions of seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.hashing import seeded_md5
from diurna.operators.ranking import ordinal


def stratified_kfold(df: DataFrame, subject: str, label: str, k: int, seed, groups=()) -> DataFrame:
    """Fold = hash-ordered position inside the class, modulo k. ``seed`` may be a column."""
    d = df.withColumn("_hx", seeded_md5(seed, F.col(subject)))
    return ordinal(d, [*groups, label], "_hx", subject).withColumn("fold", F.pmod("idx", F.lit(k))).drop("_hx", "idx", "n")


def repeated_kfold(df: DataFrame, subject: str, label: str, k: int, repeats: int, seed: int, step: int = 1) -> DataFrame:
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return stratified_kfold(d, subject, label, k, F.lit(seed) + F.lit(step) * F.col("repeat"), ["repeat"])


def inner_folds(outer: DataFrame, subject: str, label: str, fold: str, k_outer: int, k_inner: int, seed: int) -> DataFrame:
    """For each outer fold, inner folds of the subjects outside it."""
    d = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k_outer - 1)))).where(F.col(fold) != F.col("outer_fold")).drop(fold)
    return stratified_kfold(d, subject, label, k_inner, F.lit(seed) + F.col("outer_fold"), ["outer_fold"]).withColumnRenamed("fold", "inner_fold")


def adaptive_k(df: DataFrame, label: str, k: int, per_fold: int = 1) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("c"))
    return counts.agg(F.min("c").alias("smallest")).withColumn(
        "k", F.least(F.lit(k), F.greatest(F.lit(2), F.floor(F.col("smallest") / per_fold))))


def hash_holdout(df: DataFrame, row_id: str, share: float, seed: int) -> DataFrame:
    """side = test for the first floor(share * n) rows in hash order."""
    d = ordinal(df.withColumn("_hx", seeded_md5(seed, F.col(row_id))), [], "_hx", row_id)
    return d.withColumn("side", F.when(F.col("idx") < F.floor(F.col("n") * F.lit(share)), "test").otherwise("train")).drop("_hx", "idx", "n")


def sides_report(df: DataFrame, subject: str, side: str = "side") -> DataFrame:
    """Rows per side and subjects that occur on both sides."""
    per = df.groupBy(subject).agg(F.sum((F.col(side) == "train").cast("bigint")).alias("a"), F.sum((F.col(side) == "test").cast("bigint")).alias("b"))
    return per.agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")).alias("subjects_on_both"))


def final_week(df: DataFrame, subject: str, date: str, mode: str, length: int = 7, embargo: int = 0, validation: int = 0) -> DataFrame:
    """Role of each day: train, validation, embargo or test."""
    w = Window.partitionBy(subject)
    if mode == "calendar_days":
        cut = F.date_sub(F.max(date).over(w), length - 1)
    elif mode == "record_count":
        back = F.row_number().over(w.orderBy(F.col(date).desc()))
        df = df.withColumn("_back", back)
        cut = F.min(F.when(F.col("_back") <= length, F.col(date))).over(w)
    else:
        raise ValueError(f"unknown mode {mode}")
    d = df.withColumn("_cut", cut)
    before = F.col(date) < F.date_sub("_cut", embargo)
    d = d.withColumn("_last", F.max(F.when(before, F.col(date))).over(w))
    role = F.when(F.col(date) >= F.col("_cut"), "test").when(~before, "embargo")
    if validation:
        role = role.when(F.col(date) >= F.date_sub("_last", validation - 1), "validation")
    return d.withColumn("role", role.otherwise("train")).drop("_cut", "_last", "_back")


def viability(df: DataFrame, keys, label: str, min_class: int = 1) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("n_pos"))
    return g.withColumns({"n_neg": F.col("n") - F.col("n_pos"), "viable": (F.least(F.col("n_pos"), F.col("n") - F.col("n_pos")) >= min_class).cast("int")})


def official(df: DataFrame, origin: str, train: str = "train") -> Column:
    return F.when(F.col(origin) == train, "train").otherwise("test")
