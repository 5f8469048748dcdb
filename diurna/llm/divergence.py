"""Source divergence audit over count-level bitmaps.

For every group (lang, source) and every count that occurs in it, a bitset holds the ids of the
terms with that count. The ids are dealt in blocks by hash, so a bitset covers one block. The joint
cell of two groups (how many terms have count a here and count b there) is the AND of two bitsets
and its popcount; a cell's divergence is computed once and multiplied by its size. Terms that a
group lacks have no bitset: their cells are the complement, sizes less all cells found.

Counts that few terms share would make nearly empty bitsets. They are kept as lists of ids instead
(as compressed bitmaps do), and their AND with the other group's levels is a lookup.

Tasks tally words and documents per (group, term) in bounded dictionaries, so a frequent word is a
few rows per task in the shuffle. Blocks hold a bounded number of (term, group) cells, whatever the
number of terms or groups, and return one sum per pair of groups.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.frames import documents, pick, stored
from diurna.llm.registry import llm_query

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
ENTRIES = 300_000  # distinct (group, term) that a task holds before it hands them on
TERMS, CELLS = 32_768, 4_000_000  # ids of a block, and ids times groups, at most (up to the spread of a hash)
DENSE = 256  # terms from which a count has a bitset

_table = bytearray(b" " * 256)
_table[128:] = range(128, 256)
for _c in string.ascii_lowercase.encode():
    _table[_c] = _table[_c - 32] = _c
TABLE = bytes(_table)  # all but letters and non-ASCII bytes become spaces, A-Z lower case


def tally(rows: DataFrame, held: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed as far as a task sees them."""
    names = ["lang", "source", "term", "n", "docs"]

    def flush(words: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in words.items():
            size, d = len(n), docs[lang, source]
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, size).cast(pa.string()), pa.repeat(source, size).cast(pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names)
        words.clear()
        docs.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)
        new = 0
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
                found = text.as_py().encode().translate(TABLE).split()
                n, d = words[lang, source], docs[lang, source]
                new -= len(n)
                n.update(found)
                d.update(set(found))
                new += len(n)
                if new >= held:
                    yield from flush(words, docs)
                    new = 0
        yield from flush(words, docs)

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def entries(rows: DataFrame, least: int, held: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, total, lead): the kept terms of each group; ``lead`` marks one row per (lang, term)."""
    each = tally(rows, held).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    wide = each.withColumns({"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "lead": F.min("source").over(term) == F.col("source")})
    return wide.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "total", "lead")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact beyond 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    quotient = F.call_function("div", top, F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)"))
    return quotient + F.lit(1).cast("bigint")


def divergence(p, q):
    """floor((p - q) ** 2 / q); shares are at most SCALE + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


def group_table(rows: DataFrame, kept: DataFrame, block_terms: int = TERMS) -> DataFrame:
    """Per group: its words (group_n), and its lang's words (lang_n), kept terms (terms) and blocks."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.sum(F.col("lead").cast("bigint")).alias("leads"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["group_n", "leads"])
    langs = groups.groupBy("lang").agg(F.sum("group_n").alias("lang_n"), F.sum("leads").alias("terms"), F.count("*").alias("groups"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms), F.ceil(F.col("terms") * F.col("groups") / CELLS)).cast("bigint")
    return groups.drop("leads").join(langs.withColumn("blocks", blocks), "lang")


INDEX = "lang string, block bigint, source string, n bigint, p bigint, terms bigint, size bigint, dense boolean, ids binary"


def bitmaps(kept: DataFrame, groups: DataFrame, dense_from: int = DENSE) -> DataFrame:
    """The index: per (lang, block, source, count) the ids of its terms, as bitset or as a list of 32-bit ids.

    Count 0 has an empty list; it carries the share of the terms that the group lacks. ``terms`` is the block's number of ids.
    """
    placed = kept.join(groups, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "n", share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), "term")
    absent = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "source", F.lit(0).cast("bigint").alias("n"), share(F.lit(0), F.col("group_n"), F.col("terms")).alias("p"), F.lit(None).cast("string").alias("term"))

    def build(t: pa.Table) -> pa.Table:
        term = pc.dictionary_encode(t["term"].combine_chunks())
        terms, real = len(term.dictionary), term.is_valid().to_numpy(zero_copy_only=False)
        ids = term.indices.fill_null(0).to_numpy()
        source = pc.dictionary_encode(t["source"].combine_chunks())
        s, n, p = source.indices.to_numpy(), t["n"].to_numpy(), t["p"].to_numpy()
        order = np.lexsort((ids, n, s))
        cut = np.flatnonzero(np.append(True, (np.diff(s[order]) != 0) | (np.diff(n[order]) != 0)))
        first, sizes, dense, packed = order[cut], [], [], []
        for level in np.split(order, cut[1:]):
            level = level[real[level]]
            sizes.append(len(level))
            dense.append(len(level) >= dense_from)
            if dense[-1]:
                bits = np.zeros(-(-terms // 64) * 64, bool)
                bits[ids[level]] = True
                packed.append(np.packbits(bits, bitorder="little").tobytes())
            else:
                packed.append(ids[level].astype("<i4").tobytes())
        k = len(cut)
        columns = [t["lang"].combine_chunks().take(pa.array(first)), t["block"].combine_chunks().take(pa.array(first)), source.dictionary.take(pa.array(s[first])), pa.array(n[first]), pa.array(p[first])]
        return pa.table([*columns, pa.repeat(pa.scalar(terms, pa.int64()), k), pa.array(sizes, pa.int64()), pa.array(dense, pa.bool_()), pa.array(packed, pa.binary())], names=["lang", "block", "source", "n", "p", "terms", "size", "dense", "ids"])

    return placed.unionByName(absent).groupBy("lang", "block").applyInArrow(build, INDEX)


class _Group:
    """One group's levels in a block."""

    def __init__(self, terms: int):
        self.terms, self.zero = terms, 0
        self.p: list[int] = []
        self.bits: list[np.ndarray] = []
        self.few: list[tuple[int, np.ndarray]] = []

    def close(self) -> None:
        words = -(-self.terms // 64)
        self.levels = np.array(self.bits, np.uint64).reshape(len(self.bits), words)
        self.size = np.bitwise_count(self.levels).sum(1, dtype=np.int64)
        self.shares = np.array([self.zero, *self.p], np.int64)  # of the complement, then of the levels with bitsets
        self.ids = np.concatenate([i for _, i in self.few]) if self.few else np.empty(0, np.int32)
        self.by_term = np.full(self.terms, self.zero, np.int64)
        for p, level in zip(self.p, self.levels, strict=True):
            self.by_term[np.unpackbits(level.view(np.uint8), count=self.terms, bitorder="little").view(bool)] = p
        for p, ids in self.few:
            self.by_term[ids] = p
        listed = np.zeros(words * 64, bool)
        listed[self.ids] = True
        self.listed = np.packbits(listed, bitorder="little").view(np.uint64)


def pair_sums(a: _Group, b: _Group) -> tuple[int, int]:
    """The block's sums of divergence(a, b) and divergence(b, a)."""
    cells = np.zeros((len(a.levels) + 1, len(b.levels) + 1), np.int64)
    for i, level in enumerate(a.levels):
        cells[i + 1, 1:] = np.bitwise_count(level & b.levels).sum(1)
    # zeros by complement: what is in no level of the other group, neither as bitset nor as list
    cells[1:, 0] = a.size - np.bitwise_count(a.levels & b.listed).sum(1, dtype=np.int64) - cells[1:, 1:].sum(1)
    cells[0, 1:] = b.size - np.bitwise_count(b.levels & a.listed).sum(1, dtype=np.int64) - cells[1:, 1:].sum(0)
    either = np.unique(np.concatenate([a.ids, b.ids]))
    cells[0, 0] = a.terms - len(either) - cells.sum()
    p, q = a.shares[:, None], b.shares[None, :]
    pt, qt = a.by_term[either], b.by_term[either]
    # shares add up to SCALE and the number of terms, so no sum passes 64 bits
    return int((cells * divergence(p, q)).sum() + divergence(pt, qt).sum()), int((cells * divergence(q, p)).sum() + divergence(qt, pt).sum())


def pairs(index: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every two groups of a lang, in both directions."""

    def joint(t: pa.Table) -> pa.Table:
        terms = t["terms"][0].as_py()
        held: dict[str, _Group] = {}
        for source, n, p, dense, ids in zip(*[t[c].to_pylist() for c in ("source", "n", "p", "dense", "ids")], strict=True):
            g = held.setdefault(source, _Group(terms))
            if n == 0:
                g.zero = p
            elif dense:
                g.p.append(p)
                g.bits.append(np.frombuffer(ids, np.uint64))
            else:
                g.few.append((p, np.frombuffer(ids, "<i4")))
        names = sorted(held)
        for g in held.values():
            g.close()
        out = []
        for i, x in enumerate(names):
            for y in names[:i]:
                forth, back = pair_sums(held[x], held[y])
                out += [(x, y, forth), (y, x, back)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.repeat(t["lang"][0], len(out)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "source", "item", "value"])

    each = index.groupBy("lang", "block").applyInArrow(joint, "lang string, source string, item string, value bigint")
    return each.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, lang_col="lang", source_col="source", text_col="text", least: int = LEAST, top: int = TOP, block_terms: int = TERMS, dense_from: int = DENSE, held: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from every other source (``pair``) and the terms above the lang's share (``term``).

    Terms are runs of letters and non-ASCII characters, only A-Z lower-cased; a lang keeps those in
    at least ``least`` of its rows. Null lang, source and text count as empty. Groups without terms
    are audited too; a lang without kept terms gives pairs of value 0, one with a single source no pairs. Ranks go
    by value, ties by item in UTF-8 order; repeated rows count as often as they occur. An empty table gives an empty result.
    """
    rows = pick(df, lang=lang_col, source=source_col, text=text_col).na.fill("")
    kept = stored(entries(rows, least, held), "entries")
    groups = stored(group_table(rows, kept, block_terms), "groups")
    index = stored(bitmaps(kept, groups, dense_from), "bitmaps")
    other = stored(pairs(index), "pairs").withColumn("part", F.lit("pair"))

    p, q = share(F.col("n"), F.col("group_n"), F.col("terms")), share(F.col("total"), F.col("lang_n"), F.col("terms"))
    above = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return terms.select(columns).unionByName(other.withColumn("rank", F.row_number().over(order)).select(columns))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS (SELECT g.lang, g.source, kept.term, n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + 1)) // (group_n + v) AS p, 1 + ({SCALE}::HUGEINT * (total + 1)) // (lang_n + v) AS lang_p
      FROM g JOIN v USING (lang) JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT FROM f WHERE n > 0 AND p > lang_p)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o) WHERE part = 'pair' OR rank <= {TOP}
"""


@llm_query("op12_source_divergence", SQL)
def op12_source_divergence(spark, sf_dir):
    return audit(documents(spark, sf_dir))
