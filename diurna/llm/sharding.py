"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit.

Each row has a string of hash bits: 60 bits of id and text, then 60 bits of its place in the
written size table, which tell rows apart that are equal in everything. A directory pass sums
bytes under the next STEP bits of all buckets still too large, rolls the sums up to each shorter
prefix, and fixes every row of a bucket at the shortest prefix that fits. Rows of oversized
buckets alone go on to the next pass. Sums combine before the shuffle, and rows meet the
directory on their prefix, which spreads evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.frames import documents, pick, sketch, stored, text_or_empty
from diurna.llm.registry import llm_query

STEP, DEPTH = 12, 120
LIMIT = 256 * 1024  # bytes of a shard in the registered query


def shards(df: DataFrame, limit: int = LIMIT, id_col="doc_id", text_col="text", carry_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, bytes, shard (bit prefix, '' for the root), depth, shard_bytes, shard_rows, oversize.

    Every shard holds at most ``limit`` bytes of UTF-8 text, except that a single row above the
    limit is alone in its shard with ``oversize`` true. Null and empty texts count 0 bytes; null
    ids are hashed as 'null'; rows equal in id and text are split by their place in the table. An
    empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    first = sketch(F.lit("shard"), F.col("doc_id"), F.md5(text_or_empty()))
    carry = ["text"] if carry_text else []
    sized = stored(rows.select("doc_id", *carry, F.octet_length(text_or_empty()).cast("bigint").alias("bytes"), first.alias("h"), F.monotonically_increasing_id().alias("place")), "sizes")
    bits = F.concat(F.lpad(F.bin("h"), 60, "0"), F.lpad(F.bin(sketch(F.lit("place"), F.col("place"))), 60, "0"))
    active, parts = sized.withColumn("bits", bits), []
    for base in range(0, DEPTH, STEP):
        deep = base + STEP
        hist = active.groupBy(F.substring("bits", 1, deep).alias("bucket")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        depths = list(range(base if base == 0 else base + 1, deep + 1))
        rolled = hist.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
        rolled = rolled.withColumn("shard", F.expr("substring(bucket, 1, depth)"))
        sums = rolled.groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = deep >= DEPTH
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | ((F.col("depth") == deep) & F.lit(last)))
        choice = rolled.select("bucket", "shard").join(fits, "shard").groupBy("bucket").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("leaf"))
        directory = stored(hist.select("bucket").join(choice, "bucket", "left").select("bucket", "leaf.*"), "directory")
        met = active.withColumn("bucket", F.substring("bits", 1, deep)).join(directory, "bucket")
        parts.append(met.where(F.col("depth").isNotNull()).select("doc_id", *carry, "bytes", "shard", F.col("depth").cast("bigint").alias("depth"), "shard_bytes", "shard_rows"))
        over = directory.where(F.col("depth").isNull()).select("bucket")
        if over.isEmpty():
            break
        active = stored(met.where(F.col("depth").isNull()).select("doc_id", *carry, "bytes", "h", "place", "bits"), "oversized")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col="doc_id", text_col="text") -> None:
    """The rows (doc_id, text) as Parquet, one folder per shard; the root shard is named 'root'."""
    out = shards(df, limit, id_col, text_col, carry_text=True).select("doc_id", "text", F.when(F.col("shard") == "", "root").otherwise(F.col("shard")).alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
         lpad(bin(('0x' || substr(md5('shard|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (SELECT doc_id, bytes, depth, substr(bits, 1, depth) AS shard FROM d, (SELECT unnest(range(0, 61)) AS depth)),
f AS (SELECT shard, depth, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL HAVING sum(bytes) <= {LIMIT} OR count(*) = 1),
m AS (SELECT p.doc_id, p.bytes, f.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY f.depth) AS rn FROM p JOIN f USING (shard, depth))
SELECT doc_id, bytes, shard, depth::BIGINT AS depth, shard_bytes, shard_rows::BIGINT AS shard_rows, shard_bytes > {LIMIT} AS oversize FROM m WHERE rn = 1
"""


@llm_query("op2_sharding", SQL)
def op2_sharding(spark, sf_dir):
    return shards(documents(spark, sf_dir))
