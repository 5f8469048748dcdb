"""N-gram Jaccard join: a size-aware heavy-light join on word shingles.

1. Equal sets are grouped by a 128-bit digest; the first of them stands for all.
2. Screening. If J >= t, at most n - ceil(t n) shingles of a set are missing from its partner, so the
   first n - ceil(t n) + l shingles of both sets (in one global order) share l. Every set's prefix
   is exchanged once; sets with too few shared shingles drop out.
3. For the sets that remain, shingles are counted and put in order of frequency, rare first. Sets with
   too many shingles of their own drop out.
4. Small sets enumerate all 2-element subsets of their prefix (two shingles must be shared); large
   sets, and the small ones that are large enough to be their partners, post their prefix in
   inverted lists. The boundary is the size at which the total number of subsets and list entries
   to be scanned is least.
5. Every set is compared with the first set of each of its lists, and linked sets are contracted to
   components. Only lists that still hold several components are scanned, each member outside
   the list's largest component against members of other components. Pairs whose prefixes share too
   few shingles to reach the threshold are ruled out inside that join, by hashes of the prefixes,
   or by counting their common lists where a prefix is very long; whole sets are fetched for the few pairs that remain. So a
   group of many near copies is never expanded into its pairs, and no link between components is lost.

Shingles that a bounded sample shows to be frequent are last in the order and are taken as shared
without being exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm import words as W
from diurna.llm.frames import documents, in_batches, pick, sketch, stored
from diurna.llm.graph import components
from diurna.llm.registry import llm_query

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
SAMPLE, COMMON = 4_000, 4
EXTRA = 16  # l = 1 + n // EXTRA
SHORT = 1_024  # prefixes up to this length travel with the list entries, two bytes a shingle
BEFORE = 4  # shingles before an entry's own that tell whether two sets have met in an earlier list
BOUNDARIES = (0, 8, 16, 32, 64, 128)
LAST = (1 << 63) - 1


def shingles(chunk: W.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct, of every shingle; a shorter text is one shingle."""
    row, first = chunk.within(size)
    hashes = W.grams(chunk.words, size)[first] if len(row) else np.empty(0, np.uint64)
    count = np.diff(chunk.offsets)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, W.spans(chunk.words, chunk.offsets[short], chunk.offsets[short + 1])])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.append(True, (np.diff(row) != 0) | (hashes[1:] != hashes[:-1]))[: len(row)]
    return row[new], hashes[new]


def missing(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Most shingles of a set of n that a partner may lack."""
    return n - -(-n * t.numerator // t.denominator)


def _profile(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in W.chunks(b["text"], fold=True):
                row, h = shingles(c, size)
                cut = np.searchsorted(row, np.arange(c.hi - c.lo + 1))
                n = np.diff(cut)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h ^ np.uint64(x)))]) for x in (0x1234567, 0x89ABCDEF)]
                one, two = (W.signed(s[cut[1:]] - s[cut[:-1]]) for s in sums)
                part = b.slice(c.lo, c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["k"], pa.array(n), one, two], ["doc_id", "k", "n", "d1", "d2"])

    return in_batches(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, k bigint, n bigint, d1 bigint, d2 bigint")


def _frequent(rows: DataFrame, total: int, size: int) -> np.ndarray:
    """Sorted shingles in COMMON or more of about SAMPLE rows drawn by hash of the id: a bounded list."""
    share = min(1.0, SAMPLE / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in W.chunks(b["text"], fold=True):
                yield pa.RecordBatch.from_arrays([W.signed(shingles(c, size)[1])], ["token"])

    sample = rows.where(sketch(F.lit("shingles"), F.col("k")) < int(share * (1 << 60)))
    common = in_batches(sample.select("text"), run, "token bigint").groupBy("token").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.token for r in common.select("token").collect()], np.int64).view(np.uint64))


def _among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _screened(rows: DataFrame, hot, size: int, t: Fraction) -> DataFrame:
    """k of the sets whose prefix holds enough shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["k"].to_numpy()
            for c in W.chunks(b["text"], fold=True):
                row, h = shingles(c, size)
                if not len(row):
                    continue
                warm = _among(hot.value, h)
                order = np.lexsort((h, warm, row))
                row, h, warm = row[order], h[order], warm[order]
                cut = np.searchsorted(row, np.arange(c.hi - c.lo + 1))
                n = np.diff(cut)
                place = np.arange(len(row)) - cut[:-1][row]
                inside = place < (missing(n, t) + 1 + n // EXTRA)[row]
                partner = -(-n * t.numerator // t.denominator)  # least size of a partner
                given = np.bincount(row[inside & warm], minlength=len(n))
                need = np.maximum(1 + partner // EXTRA - given, 0)
                sent = inside & ~warm  # of every set: a partner may need those of a set that itself needs none
                yield pa.RecordBatch.from_arrays([W.signed(h[sent]), pa.array(ids[c.lo + row[sent]]), pa.array(need[row[sent]].astype(np.int32))], ["token", "k", "need"])
                free = np.flatnonzero((need == 0) & (n > 0))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(free), pa.int64()), pa.array(ids[c.lo + free]), pa.array(np.zeros(len(free), np.int32))], ["token", "k", "need"])

    sent = in_batches(rows.select("k", "text"), run, "token bigint, k bigint, need int")
    # a set of need 0 has a null token, too: spread over the tasks by id
    place = F.coalesce("token", F.col("k"))
    w = Window.partitionBy(place)
    shared = (F.min("k").over(w) < F.max("k").over(w)) & F.col("token").isNotNull()
    marked = sent.withColumn("shared", shared).where("shared or token is null")
    return marked.groupBy("k").agg(F.sum(F.col("shared").cast("int")).alias("got"), F.min("need").alias("need")).where("got >= need").select("k")


def _sets(rows: DataFrame, hot, size: int) -> DataFrame:
    """k, n, tokens (cold, sorted) and warm (frequent, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in W.chunks(b["text"], fold=True):
                row, h = shingles(c, size)
                warm = _among(hot.value, h)
                lists = []
                for part in (~warm, warm):
                    cut = np.searchsorted(row[part], np.arange(c.hi - c.lo + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), W.signed(h[part])))
                n = np.bincount(row, minlength=c.hi - c.lo)
                yield pa.RecordBatch.from_arrays([b["k"].slice(c.lo, c.hi - c.lo), pa.array(n.astype(np.int64)), *lists], ["k", "n", "tokens", "warm"])

    return in_batches(rows.select("k", "text"), run, "k bigint, n bigint, tokens array<bigint>, warm array<bigint>")


def _missing(n: Column, t: Fraction) -> Column:
    return (n - F.ceil(n * t.numerator / t.denominator)).cast("int")


def _ordered(sets: DataFrame, t: Fraction) -> DataFrame:
    """k, n, prefix: the shared shingles among the first missing(n) + 2, rare first, with their counts."""
    w = Window.partitionBy("token")
    counted = sets.select("k", F.explode("tokens").alias("token")).withColumn("df", F.count("*").over(w))
    known = counted.groupBy("k").agg(F.sum((F.col("df") == 1).cast("int")).alias("own"), F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "token")))).alias("cold"))
    met = sets.select("k", "n", F.transform("warm", lambda x: F.struct(F.lit(LAST).alias("df"), x.alias("token"))).alias("warm")).join(known.withColumnRenamed("k", "ok"), F.col("k") == F.col("ok"), "left")
    cold = F.coalesce("cold", F.array().cast("array<struct<df:bigint,token:bigint>>"))
    room = _missing(F.col("n"), t) + 2 - F.coalesce("own", F.lit(0))
    return met.where((room >= 2) & (F.col("n") >= 3)).select("k", "n", room.cast("int").alias("room"), F.slice(F.concat(cold, "warm"), F.lit(1), room.cast("int")).alias("prefix"))


def _boundary(docs: DataFrame, total: int) -> int:
    """Size up to which enumerating 2-subsets costs less than scanning lists: one row of sums per candidate."""
    m = F.size("prefix")
    subsets = m * (m - 1) / 2
    scans = F.aggregate("prefix", F.lit(0.0), lambda a, x: a + F.least(x["df"], F.lit(total)).cast("double"))
    sums = [F.sum(F.when(F.col("n") <= x, subsets).otherwise(scans)).alias(f"c{x}") for x in BOUNDARIES]
    row = docs.agg(*sums).first()
    costs = {x: row[f"c{x}"] or 0.0 for x in BOUNDARIES}
    return min(costs, key=lambda x: (costs[x], x))


def _postings(docs: DataFrame, x: int, t: Fraction) -> DataFrame:
    """(key, k, n, before): 2-subsets of the small sets' prefixes, single shingles of the large ones and their small partners, with the shingles just before."""
    tokens = F.transform("prefix", lambda p: p["token"])
    pairs = F.flatten(F.transform("tokens", lambda a, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b)))))
    named = docs.select("k", "n", "room", tokens.alias("tokens"))
    light = named.where(F.col("n") <= x).select("k", "n", F.explode(pairs).alias("key"), F.array().cast("array<bigint>").alias("before"))
    single = named.where(F.col("n") >= ceil(t * (x + 1))).select("k", "n", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("room") - 1)).alias("at", "token"))
    before = F.slice("tokens", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least(F.col("at"), F.lit(BEFORE)))
    return light.unionByName(single.select("k", "n", F.xxhash64("token").alias("key"), before.alias("before")))


def _linked(a: Column, b: Column, na: Column, nb: Column, t: Fraction) -> Column:
    """J >= p/q: (p + q) * shared >= p * (na + nb)."""
    p, q = t.numerator, t.denominator
    return F.size(F.array_intersect(a, b)) * (p + q) >= p * (na + nb)


def _near(na: Column, nb: Column, t: Fraction) -> Column:
    return (na * t.denominator >= nb * t.numerator) & (nb * t.denominator >= na * t.numerator)


def links(rows: DataFrame, total: int, size: int = SHINGLE, t: Fraction = SIMILARITY) -> DataFrame:
    """Edges (a, b) that tie all linked rows of ``rows(k, text)``: every edge is a link, every linked pair is connected."""
    hot = rows.sparkSession.sparkContext.broadcast(_frequent(rows, total, size))  # at most SAMPLE rows' shingles / COMMON
    passed = stored(_screened(rows, hot, size, t), "screened").withColumnRenamed("k", "pk")
    sets = stored(_sets(rows.join(passed, F.col("k") == F.col("pk")).select("k", "text"), hot, size), "sets")
    docs = stored(_ordered(sets, t), "prefixes")
    x = _boundary(docs, total)
    posts = stored(_postings(docs, x, t), "postings")
    whole = sets.join(docs.select(F.col("k").alias("dk")).distinct(), F.col("k") == F.col("dk")).select("k", "n", F.concat("tokens", "warm").alias("tokens"))
    whole = stored(whole, "whole")

    lead = posts.groupBy("key").agg(F.min("k").alias("lead"), F.max("k").alias("last")).where("lead < last").select(F.col("key").alias("lkey"), "lead")
    pairs = posts.join(lead, F.col("key") == F.col("lkey")).where("k <> lead").select("k", "lead").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs (k, lead), by their whole sets."""
        lengths = whole.select("k", "n").distinct()
        a, b = lengths.toDF("ak", "an"), lengths.toDF("bk", "bn")
        near = pairs.join(a, F.col("k") == F.col("ak")).join(b, F.col("lead") == F.col("bk")).where(_near(F.col("an"), F.col("bn"), t)).select("k", "lead").distinct()
        a, b = whole.toDF("ak", "an", "at"), whole.toDF("bk", "bn", "bt")
        held = near.join(a, F.col("k") == F.col("ak")).join(b, F.col("lead") == F.col("bk"))
        return held.where(_linked(F.col("at"), F.col("bt"), F.col("an"), F.col("bn"), t)).select(F.col("k").alias("a"), F.col("lead").alias("b"))

    first = stored(verified(pairs), "first-links")

    groups = components(first, "first-components").withColumnsRenamed({"node": "gk", "component": "gc"})
    placed = posts.join(groups, F.col("k") == F.col("gk"), "left").select("key", "k", "n", "before", F.coalesce("gc", "k").alias("c"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1").select(F.col("key").alias("mkey"), F.col("top.c").alias("main"))
    # Lists that hold several components. 16-bit hashes of the prefix go along, so that most pairs are ruled out
    # inside the join: shared hashes, and the shingles that lost theirs to another, bound the shared shingles from above.
    marks = F.array_distinct(F.transform("prefix", lambda x: (F.pmod(F.xxhash64(x["token"]), F.lit(1 << 16)) - (1 << 15)).cast("smallint")))
    small = docs.select(F.col("k").alias("sk"), F.size("prefix").alias("m"), F.when(F.size("prefix") <= SHORT, marks).alias("px"))
    small = small.select("sk", "px", (F.col("m") - F.size("px")).alias("lost"))
    open_posts = placed.join(main, F.col("key") == F.col("mkey")).join(small, F.col("k") == F.col("sk")).select("key", "k", "n", "before", "c", "main", "px", "lost")
    open_posts = stored(open_posts, "open-lists")
    p, q = open_posts.where("c <> main").alias("p"), open_posts.alias("q")

    def need(na: Column, nb: Column) -> Column:
        """So many of the first missing(n) + 2 shingles must be shared, as all that follow can at most be."""
        after = F.greatest(na - _missing(na, t), nb - _missing(nb, t)) - 2
        return F.ceil((na + nb) * t.numerator / (t.numerator + t.denominator) - after - 1e-9)

    pn, qn = F.col("p.n"), F.col("q.n")
    cross = (F.col("p.key") == F.col("q.key")) & (F.col("p.c") != F.col("q.c")) & ((F.col("q.c") == F.col("q.main")) | (F.col("p.k") < F.col("q.k"))) & _near(pn, qn, t)
    unknown = F.col("p.px").isNull() | F.col("q.px").isNull()
    # a pair whose last shingles before this one overlap meets in an earlier list, too
    earlier = F.arrays_overlap("p.before", "q.before")
    both = p.join(q, cross & (unknown | (~earlier & (F.size(F.array_intersect("p.px", "q.px")) + F.least("p.lost", "q.lost") >= need(pn, qn)))))
    # single-shingle lists cover one shingle less than the prefix
    least = F.when(unknown & (pn > x) & (qn > x), need(pn, qn) - 1).otherwise(0)
    pair = both.select(F.least("p.k", "q.k").alias("k"), F.greatest("p.k", "q.k").alias("lead"), least.alias("least"))
    counted = pair.groupBy("k", "lead").agg(F.count("*").alias("shared"), F.min("least").alias("least"))
    rest = verified(counted.where("shared >= least").select("k", "lead"))
    return first.unionByName(rest).distinct()


def near_duplicates(df: DataFrame, id_col="doc_id", text_col="text", size: int = SHINGLE, t: Fraction = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and link with nothing. Rows with the same id are one
    document; null ids come last, are one id, and give a null component unless an id is reachable.
    An empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)))
    base = stored(_profile(rows, size), "profile")
    # written, so that the join is dealt anew and adaptive execution can split a very large group of equal sets
    firsts = stored(base.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("k").alias("first")), "firsts")
    equal = base.join(firsts, ["n", "d1", "d2"])
    later = equal.groupBy("k").agg(F.min(F.col("k") > F.col("first")).alias("later")).where("later").select(F.col("k").alias("lk"))
    later = stored(later, "later-copies")
    single = rows.join(later, F.col("k") == F.col("lk"), "left_anti").select("k", "text")
    found = links(single, base.count(), size, t)
    edges = found.unionByName(equal.where("k > first").select(F.col("k").alias("a"), F.col("first").alias("b")))
    groups = components(edges, "document-components")
    out = base.join(groups, F.col("k") == F.col("node"), "left")
    component = F.coalesce("component", "k")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(component != LAST, component).alias("component_id"))


def representatives(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows whose id is the smallest of their component, one row per id, with all columns; rows with a null component stay."""
    marks = near_duplicates(df, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    key = F.col(f"c{df.columns.index(id_col)}")
    return flat.join(marks, key == F.col("gone"), "left_anti").toDF(*df.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id AS v, doc_id AS o FROM d UNION SELECT z.v, t.o FROM r t JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) z ON z.u = t.v WHERE t.o < z.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.o AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(o) AS o FROM r GROUP BY v) g ON g.v = d.doc_id
"""


@llm_query("op8_ngram_jaccard", SQL)
def op8_ngram_jaccard(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
