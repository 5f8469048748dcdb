"""Shapes of plans that decide whether an operator holds at size."""

from pyspark.sql import functions as F

from diurna.operators import ranking as R


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_never_broadcast_to_their_group_sizes(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    plan = physical(R._edges(d, ["g"], "v", F.xxhash64("v"), 100, 8))
    assert "LeftOuter, BuildRight" in plan and "BuildLeft" not in plan and "Inner" not in plan


def test_edges_of_null_groups(spark):
    d = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r._edges for r in R._edges(d, ["g"], "v", F.xxhash64("v"), 100, 8).collect()}
    assert set(got) == {1, 2} and all(len(e) == 7 and e == sorted(e) for e in got.values())


def test_a_task_groups_a_bounded_number_of_subjects(spark, tmp_path, monkeypatch):
    """The hash tables of a grouping by subject do not grow with the table's file."""
    from diurna.plans import load_all, q_14_models
    from diurna.plans.registry import QUERIES
    from diurna.sources import carriers

    load_all()
    rows = [(i, ) for i in range(1000)] + [(5, ), (None, )]
    spark.createDataFrame(rows, "c_custkey bigint").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(carriers, "PER_TASK", 100)
    t = carriers.Tables(spark, str(tmp_path))
    assert q_14_models.wide(t).rdd.getNumPartitions() == 11
    sizes = [r["count"] for r in t.oof_by_subject.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6 * 1002 and max(sizes) < 6 * 200
    assert sorted(map(str, t.oof.collect())) == sorted(map(str, t.oof_by_subject.collect()))
    got = {r.subject_id for r in QUERIES["oof_pivot"](spark, str(tmp_path)).collect()}
    assert len(got) == 1001
