"""Connected components by repeated minimum labels over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.frames import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Edges are turned into stars around smaller nodes (each node's larger neighbours, then its
    smaller ones, are tied to its smallest neighbour) until nothing changes, which takes about
    log(n) rounds even on long chains. A hub's neighbours are only ever reduced to a minimum by
    aggregation and joined back, never gathered. Each round is written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(down, large.a == down.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stored(small.unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark is not None and tuple(mark) == tuple(seen):
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
