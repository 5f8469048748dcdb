"""Substring dedup: seed and extend on winnowed anchors.

Every window of ``length`` words picks the smallest hash among its ANCHOR-word sequences (winnowing),
so two equal windows hold the same anchor at the same place. Anchors found in two documents are
seeds; everything else is dropped at once. A seed is extended to both sides over the windows that
picked it, but not by joining documents in pairs, which a passage in thousands of documents would
square: the windows around a seed are dealt by their anchor, one row for each run of them, and meet
by the hash of their whole word sequence, and a window repeats if its sequence also starts in a
document with a smaller id. Overlapping repeated windows join into maximal repeats, whose words are
removed. Word hashes have 64 bits (``words.hashed``); two words that agree in them count as one
word. Anchor and window together, or two hashes of the window, make 128 bits.

Anchors that a bounded sample already shows in several documents count as seeds without being
exchanged, and the windows around them are dealt one by one. Windows that the sample shows in
several documents are not dealt at all: the smallest id of each comes from a pass of its own and
goes to all tasks. Copies of a whole word sequence are resolved by one digest and only the first of
them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm import words as W
from diurna.llm.frames import documents, pick, sketch, stored
from diurna.llm.registry import llm_query

LENGTH, ANCHOR = 13, 5
SAMPLE, COMMON = 4_000, 3  # rows sampled for frequent anchors; an anchor in so many of them is frequent
LAST = (1 << 63) - 1  # place of null ids: after all others


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(chunk: W.Chunk, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word of the window, first word of its anchor, the anchor's hash) of every window."""
    row, first = chunk.within(length)
    if not len(row):
        return row, first, first, np.empty(0, np.uint64)
    hashes = W.grams(chunk.words, k)
    span = length - k + 1
    low, at = hashes[first].copy(), first.copy()
    for d in range(1, span):
        other = hashes[first + d]
        less = other < low
        low[less] = other[less]
        at[less] = first[less] + d
    return row, first, at, low


def profile(rows: DataFrame) -> DataFrame:
    """k (the id, null last), row (hash of the text), n_words, sha (of the words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha = [], []
            for t in b["text"]:
                words = (t.as_py() or "").encode().split()
                n.append(len(words))
                sha.append(_digest(words))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["k"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), b["row"]], ["doc_id", "k", "n_words", "sha", "row"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, k bigint, n_words bigint, sha string, row bigint")


def second(words: np.ndarray, length: int) -> np.ndarray:
    """Another hash of every window, independent of ``W.grams(words, length)``."""
    return W.grams(W.mix(words ^ np.uint64(99)), length)


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """Texts of about SAMPLE of n rows drawn by hash of the id."""
    share = min(1.0, SAMPLE / max(n, 1))
    return stored(rows.where(sketch(F.lit("anchors"), F.col("k")) < int(share * (1 << 60))).select("text"), "sample")


def frequent_anchors(sample: DataFrame, length: int, k: int) -> np.ndarray:
    """Sorted anchors in COMMON or more rows of the sample: a bounded list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in W.chunks(b["text"]):
                row, _, _, low = anchors(c, length, k)
                if len(row):
                    pairs = np.unique(np.stack([low.view(np.int64), row], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0])], ["anchor"])

    common = sample.mapInArrow(run, "anchor bigint").groupBy("anchor").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.anchor for r in common.select("anchor").collect()], np.int64).view(np.uint64))


def frequent_windows(sample: DataFrame, hot: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes, by the first, of windows in COMMON or more rows of the sample; their anchors are all in ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in W.chunks(b["text"]):
                row, first, _, low = anchors(c, length, k)
                on = np.isin(low, hot)
                if on.any():
                    one, two = W.grams(c.words, length)[first[on]], second(c.words, length)[first[on]]
                    found = np.unique(np.stack([one.view(np.int64), two.view(np.int64), row[on]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["h1", "h2"])

    if not len(hot):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    common = sample.mapInArrow(run, "h1 bigint, h2 bigint").groupBy("h1", "h2").count().where(F.col("count") >= COMMON)
    pairs = np.array([(r.h1, r.h2) for r in common.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def listed(ones: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``ones``, whether it is there) of each hash."""
    if not len(ones):
        return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
    place = np.minimum(np.searchsorted(ones, one), len(ones) - 1)
    return place, ones[place] == one


def first_ids(rows: DataFrame, ones: np.ndarray, twos: np.ndarray, length: int) -> np.ndarray:
    """Smallest k of the rows that hold each listed window."""
    first = np.full(len(ones), LAST)
    if not len(ones):
        return first
    often = rows.sparkSession.sparkContext.broadcast((ones, twos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = often.value
        least = np.full(len(ones), LAST)
        for b in batches:
            ids = b["k"].to_numpy()
            for c in W.chunks(b["text"]):
                row, start = c.within(length)
                if not len(row):
                    continue
                place, there = listed(ones, W.grams(c.words, length)[start])
                if there.any():
                    row, start, place = row[there], start[there], place[there]
                    same = second(c.words, length)[start] == twos[place]
                    np.minimum.at(least, place[same], ids[c.lo + row[same]])
        at = np.flatnonzero(least < LAST)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at])], ["place", "k"])

    for r in rows.select("k", "text").mapInArrow(run, "place bigint, k bigint").groupBy("place").agg(F.min("k").alias("k")).collect():
        first[r.place] = r.k
    return first


def repeats(df: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, spans (array of [first word, end) of maximal repeats).

    Null text has no words. Null ids come after all others and are one id; rows with the same id do
    not count as smaller than each other. Texts under ``length`` words lose nothing. A copy of a
    whole word sequence of at least ``length`` words with a smaller id loses all. An empty table
    gives an empty result.
    """
    k = min(ANCHOR, length)
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    rows = rows.withColumn("row", F.xxhash64("text"))  # tells the texts of one id apart
    base = stored(profile(rows), "profile")
    firsts = stored(base.groupBy("sha").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last"), "firsts")
    copies = base.select("sha", "k", "n_words", "row").distinct().join(firsts.drop("last"), "sha").where("k > first")
    copies = stored(copies.select("k", "row", F.col("n_words") >= length), "copies").toDF("k", "row", "long")
    n = base.count()
    later = base.select("sha", "k").join(firsts.drop("last"), "sha", "left").groupBy("k").agg(F.min(F.coalesce(F.col("k") > F.col("first"), F.lit(False))).alias("gone"))
    skip = stored(later.where("gone").select(F.col("k").alias("ck")), "skipped")

    # ids all of whose rows are later copies take no part
    first_rows = rows.join(skip, rows.k == skip.ck, "left_anti").select("k", "row", "text")
    # both lists come from about SAMPLE rows and hold at most 1 / COMMON of their anchors and windows
    share = df.sparkSession.sparkContext.broadcast
    sample = sampled(rows, n)
    common = frequent_anchors(sample, length, k)
    ones, twos = frequent_windows(sample, common, length, k)
    hot, often = share(common), share((ones, twos, first_ids(first_rows, ones, twos, length)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchors of each document; a warm row, with the id as anchor, stands for 'holds a frequent one'."""
        for b in batches:
            ids = b["k"].to_numpy()
            for c in W.chunks(b["text"]):
                row, _, _, low = anchors(c, length, k)
                if not len(row):
                    continue
                new = np.append(True, (np.diff(row) != 0) | (low[1:] != low[:-1]))  # neighbouring windows mostly share theirs
                row, low = row[new], low[new]
                is_hot = np.isin(low, hot.value)
                some = np.unique(ids[c.lo + row[is_hot]])
                cold = ids[c.lo + row[~is_hot]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(low[~is_hot].view(np.int64), some)), pa.array(np.append(cold, some)), pa.array(np.arange(len(cold) + len(some)) >= len(cold))],
                    ["anchor", "k", "warm"])

    # dealt once: an anchor that is not frequent is in a bounded share of the documents
    alike = Window.partitionBy("anchor", "warm")
    asked = first_rows.mapInArrow(ask, "anchor bigint, k bigint, warm boolean")
    shared = asked.withColumns({"lo": F.min("k").over(alike), "hi": F.max("k").over(alike)}).where("warm or lo < hi")
    seeds = shared.groupBy("k").agg(F.collect_set(F.when(~F.col("warm"), F.col("anchor"))).alias("seeds"))
    seeds = stored(seeds, "seeds").withColumnRenamed("k", "sk")
    held = first_rows.join(seeds, F.col("k") == F.col("sk")).select("k", "row", "text", "seeds")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows around seeds: what they are dealt by, id, row digest, first word of the first window, hashes.

        Cold windows are dealt by their anchor. Those around frequent anchors are dealt by one hash and
        have another. Frequent windows are judged here: what repeats goes by the id, with null hashes.
        """
        ones, twos, least = often.value
        for b in batches:
            ids = b["k"].to_numpy()
            seeds_of = [np.sort(s.values.to_numpy().view(np.uint64)) if s.is_valid else np.empty(0, np.uint64) for s in b["seeds"]]
            text_row = b["row"].to_numpy()
            for c in W.chunks(b["text"]):
                row, first, _, low = anchors(c, length, k)
                if not len(row):
                    continue
                cuts = np.searchsorted(row, np.arange(c.hi - c.lo + 1))
                warm = np.isin(low, hot.value)
                on = warm.copy()
                for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    on[a:z] |= np.isin(low[a:z], seeds_of[c.lo + i])
                row, first, by, warm = row[on], first[on], low[on], np.flatnonzero(warm[on])
                of = ids[c.lo + row]
                h = W.grams(c.words, length)[first]
                known, new = np.zeros(len(row), bool), np.ones(len(row), bool)
                if len(warm):
                    two = second(c.words, length)[first[warm]]
                    place, there = listed(ones, h[warm])
                    there[there] = twos[place[there]] == two[there]
                    by[warm], h[warm] = h[warm], two
                    by[warm[there]] = of[warm[there]].view(np.uint64)
                    known[warm[there]] = True
                    use = np.ones(len(row), bool)
                    use[warm[there]] = of[warm[there]] > least[place[there]]
                    row, first, by, of, h, known, new = (x[use] for x in (row, first, by, of, h, known, new))
                if not len(row):
                    continue
                new[1:] = (np.diff(row) != 0) | (by[1:] != by[:-1]) | (np.diff(first) != 1)
                start = np.flatnonzero(new)
                hashes = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(h.view(np.int64), mask=known))
                yield pa.RecordBatch.from_arrays(
                    [W.signed(by[start]), pa.array(of[start]), pa.array(text_row[c.lo + row[start]]), pa.array((first - c.offsets[row])[start].astype(np.int32)), hashes],
                    ["by", "k", "row", "at", "h"])

    runs = held.mapInArrow(extend, "by bigint, k bigint, row bigint, at int, h array<bigint>").repartition("by")
    windows = runs.select("by", "k", "row", "at", F.posexplode("h").alias("d", "h"))
    # equal windows are dealt by the same value: this does not deal them again
    windows = windows.withColumn("first", F.min("k").over(Window.partitionBy("by", "h"))).where("h is null or k > first")
    hits = windows.groupBy("k", "row").agg(F.collect_set(F.col("at") + F.col("d")).alias("at")).withColumnsRenamed({"k": "hk", "row": "hrow"})
    # the row is compared after the join, whose key stays the one that the texts are already dealt by
    found = held.select("k", "row", "text").join(hits, F.col("k") == F.col("hk")).where(F.col("row").bitwiseXOR(F.col("hrow")) == 0).select("k", "text", "row", "at")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, t, row, at in zip(b["k"].to_pylist(), b["text"], b["row"].to_pylist(), b["at"], strict=True):
                words = (t.as_py() or "").encode().split()
                start = np.sort(at.values.to_numpy())
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + length, -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                out.append((key, row, int(gone.sum()), _digest(list(compress(words, ~gone))), edge.reshape(-1, 2).tolist()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["rk", "rrow", "gone", "left_sha", "spans"])

    removed = found.mapInArrow(remove, "rk bigint, rrow bigint, gone bigint, left_sha string, spans array<array<bigint>>").dropDuplicates(["rk", "rrow"])
    removed = stored(removed, "removed")
    out = base.join(removed, (F.col("k") == F.col("rk")) & (F.col("row") == F.col("rrow")), "left")
    gone_copies = copies.where("long").select(F.col("k").alias("gk"), F.col("row").alias("grow"))
    out = out.join(gone_copies, (F.col("k") == F.col("gk")) & (F.col("row") == F.col("grow")), "left")
    whole = F.col("gk").isNotNull()
    everything = F.array(F.array(F.lit(0).cast("bigint"), F.col("n_words")))
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (h) WHERE doc_id > first),
a AS (SELECT doc_id, list(j ORDER BY j) AS gone FROM r GROUP BY doc_id),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0),
k AS (SELECT u.doc_id, string_agg(w[u.j], ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND r.j = u.j WHERE r.j IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@llm_query("op4_substring_dedup", SQL)
def op4_substring_dedup(spark, sf_dir):
    return repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
