"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a table of distinct digests with the row to keep, cut into buckets of about
``BUCKET`` digests by digest prefix, and one binary-fuse filter per bucket. Incoming rows are first
grouped among themselves by digest (partial aggregation, so a group with a third of all rows
combines before the shuffle). Each distinct digest then meets its bucket's filter; digests that
the filter rules out are new, the few others are joined with the exact bucket, and the texts behind
a match are compared byte by byte before they count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.frames import SPACES, documents, in_batches, pick, stored, text_or_empty
from diurna.llm.registry import llm_query
from diurna.llm.words import mix

BUCKET = 50_000


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments for each key, and its 16-bit fingerprint."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    places = [(mix(h + np.uint64(i + 1)) % np.uint64(segment) + (first + np.uint64(i)) * np.uint64(segment)).astype(np.int64) for i in range(3)]
    return np.stack(places, 1), (h & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_build(keys: np.ndarray) -> bytes:
    """Binary-fuse filter of distinct 64-bit keys: header (seed, segment length, segments), then 16-bit slots.

    Slots hit by one remaining key are peeled in whole rounds; fingerprints are then set in reverse
    order of the rounds. A seed whose peeling gets stuck is replaced by the next one.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = 1.3 if n < 1000 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, -(-int(n * factor + 8) // segment))
    seed = 1
    while True:
        slots, prints = _slots(keys, seed, segment, segments)
        size = segment * (segments + 2)
        count, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids = np.repeat(np.arange(n), 3)
        np.add.at(count, slots.ravel(), 1)
        np.add.at(total, slots.ravel(), ids)
        rounds, left = [], n
        while left:
            single = np.flatnonzero(count == 1)
            key, where = np.unique(total[single], return_index=True)
            if not len(key):
                break
            rounds.append((key, single[where]))
            flat = slots[key].ravel()
            np.subtract.at(count, flat, 1)
            np.subtract.at(total, flat, np.repeat(key, 3))
            left -= len(key)
        if not left:
            break
        seed += 1
        if seed % 8 == 0:
            segments += 1 + segments // 10
    table = np.zeros(size, np.uint16)
    for key, own in reversed(rounds):
        table[own] = 0
        s = slots[key]
        table[own] = prints[key] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
    return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()


def fuse_contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 65,536."""
    seed, segment, segments = np.frombuffer(filter_bytes, np.int64, 3)
    table = np.frombuffer(filter_bytes, np.uint16, offset=24)
    s, prints = _slots(keys.astype(np.uint64), int(seed), int(segment), int(segments))
    return (table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]) == prints


def digests(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, points (code points of the original text), sha (of the text without white space)."""
    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.select("doc_id", F.length(text_or_empty()).cast("bigint").alias("points"), F.sha2(F.regexp_replace(text_or_empty(), SPACES, ""), 256).alias("sha"))


def _short():
    return F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")


def _best():
    """Greatest: most code points, then smallest doc_id, null ids last."""
    return F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.coalesce(F.col("doc_id"), F.lit(0))).alias("minus"))


def grouped(rows: DataFrame) -> DataFrame:
    """(sha, best, n): distinct digests of a batch with the row that stays."""
    return rows.groupBy("sha").agg(F.max(_best()).alias("best"), F.count("*").alias("n"))


def bucket_count(entries: DataFrame) -> int:
    return max(1, -(-entries.count() // BUCKET))


def snapshot(entries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(exact buckets, filters, number of buckets) of ``grouped`` entries, written once and never changed."""
    buckets = bucket_count(entries)
    exact = stored(entries.withColumn("bucket", _short() % buckets), "snapshot")

    def build(group: pa.Table) -> pa.Table:  # one bucket of about BUCKET keys
        blob = fuse_build(group["key"].to_numpy().view(np.uint64))
        return pa.table({"bucket": group["bucket"][:1], "filter": pa.array([blob], pa.binary())})

    filters = exact.select("bucket", _short().alias("key")).groupBy("bucket").applyInArrow(build, "bucket bigint, filter binary")
    return exact, stored(filters, "filters"), buckets


def screen(entries: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Entries with ``maybe``: false means surely absent from the snapshot."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = None
        for b in batches:  # the filter row comes first in its bucket
            flags = b["filter"]
            key = b["key"].to_numpy(zero_copy_only=False)
            bucket = b["bucket"].to_numpy(zero_copy_only=False)
            sha = b["sha"]
            out = np.zeros(len(key), bool)
            edge = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(key)], strict=True):
                if lo == hi:
                    continue
                if flags[int(lo)].is_valid:
                    blob, lo = (int(bucket[lo]), flags[int(lo)].as_py()), lo + 1
                if blob is not None and blob[0] == bucket[hi - 1] and lo < hi:
                    out[lo:hi] = fuse_contains(blob[1], key[lo:hi].view(np.uint64))
            yield pa.RecordBatch.from_arrays([sha, pa.array(out)], ["sha", "maybe"])

    asked = entries.select((_short() % buckets).alias("bucket"), _short().alias("key"), "sha", F.lit(None).cast("binary").alias("filter"))
    given = filters.select("bucket", F.lit(0).cast("bigint").alias("key"), F.lit(None).cast("string").alias("sha"), "filter")
    met = given.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("filter").isNull())
    return in_batches(met, probe, "sha string, maybe boolean").where("sha is not null")


def dedup(df: DataFrame, incoming, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, points, text_sha256, keep_id, group_size, kept.

    ``incoming`` is a condition on doc_id that tells the new batch from the rows of the snapshot;
    both are judged together. Null text counts as empty; a null id sorts after all ids. Of equal
    texts the row with the most code points stays, then the smallest doc_id. Rows equal in
    doc_id and code points too are all marked as kept; ``survivors`` leaves one of them.
    """
    rows = stored(digests(df, id_col, text_col).withColumn("new", F.coalesce(incoming, F.lit(True))), "digests")
    old, filters, buckets = snapshot(grouped(rows.where("not new")))
    new = stored(grouped(rows.where("new")), "batch")
    maybe = stored(screen(new, filters, buckets).where("maybe").select("sha"), "positives")
    both = old.select("sha", F.col("best").alias("old_best"), F.col("n").alias("old_n")).join(new.join(maybe, "sha"), "sha")
    same = stored(_byte_check(df, both, id_col, text_col), "matches")
    merged = same.select("sha", F.greatest("best", "old_best").alias("best"), (F.col("n") + F.col("old_n")).alias("n"))
    alone = old.select("sha", "best", "n").join(same.select("sha"), "sha", "left_anti").unionByName(new.join(same.select("sha"), "sha", "left_anti"))
    found = rows.join(merged.unionByName(alone), "sha")
    kept = _best() == F.col("best")
    return found.select("doc_id", "points", F.col("sha").alias("text_sha256"), F.when(F.col("best.known"), -F.col("best.minus")).alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))


def _byte_check(df: DataFrame, both: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (batch entry, snapshot entry) of one digest whose kept rows have the same bytes without white space.

    One row of each side stands for its group: within a side rows were grouped by the same digest.
    Only the texts of these rows are read again and moved.
    """
    wanted = both.select("sha", "best.*").unionByName(both.select("sha", "old_best.*"))
    wanted = stored(wanted.select(_short().alias("short"), F.when(F.col("known"), -F.col("minus")).alias("wanted_id")).distinct(), "wanted")
    texts = pick(df, doc_id=id_col, text=text_col).select("doc_id", F.regexp_replace(text_or_empty(), SPACES, "").alias("bare"))
    texts = texts.withColumn("sha", F.sha2("bare", 256))
    held = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.wanted_id) & (_short() == F.col("short")))
    held = held.groupBy("sha").agg(F.min("bare").alias("lo"), F.max("bare").alias("hi")).where("lo = hi").select("sha")
    return both.join(held, "sha")


def survivors(df: DataFrame, incoming=None, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``df`` that stay, one of each class of equal texts, with all columns."""
    width = len(df.columns)
    incoming = F.crc32(F.col("doc_id").cast("string")) % 4 == 0 if incoming is None else incoming
    marks = dedup(df, incoming, id_col, text_col).where("kept").groupBy("text_sha256", "doc_id", "points").agg(F.count("*").alias("ties"))
    flat = df.toDF(*[f"c{i}" for i in range(width)])
    text, key = (F.col(f"c{df.columns.index(c)}") for c in (text_col, id_col))
    flat = flat.withColumn("sha", F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, ""), 256)).withColumn("len", F.length(F.coalesce(text, F.lit(""))))
    met = flat.join(marks.withColumnsRenamed({"doc_id": "mark_id"}), (F.col("sha") == F.col("text_sha256")) & key.eqNullSafe(F.col("mark_id")) & (F.col("len") == F.col("points")))
    one = met.where("ties = 1").unionByName(met.where("ties > 1").dropDuplicates(["sha"]))
    return one.select(*[F.col(f"c{i}") for i in range(width)]).toDF(*df.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@llm_query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark, sf_dir):
    """A quarter of the ids (by crc32) is the incoming batch, the rest the snapshot."""
    out = dedup(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 4 == 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
