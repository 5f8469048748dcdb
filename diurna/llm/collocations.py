"""Phrase collocation mining with HAT-tries.

Each task counts phrases in a trie over word ids: the root leads from a first word to a hash
container of packed word sequences; a container that grows too large bursts into a node with one
container per second word. Positions enter the trie once, as their longest window, and the counts of
shorter phrases are sums over subtrees. When the trie holds too many entries its largest subtrees
are spilled whole, as runs in phrase order; runs meet, by the exchange, in the partition of their
prefix and are summed there. A prefix is a phrase's first word and six hash bits of its second, so
that no first word, however frequent, is one partition's work.

A phrase can only reach the support if the phrases inside it do. The text is therefore read three
times: for words, for pairs of frequent words, and for windows of frequent pairs. What is frequent
is told to the tasks by bitmaps of a fixed number of hash bits; a collision lets a rare phrase into
the trie, where it is counted and dropped, so the bitmaps change the cost and never the result.
"""

from __future__ import annotations

import string
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.frames import documents, pick, stored
from diurna.llm.registry import llm_query

SUPPORT, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
TOKENS = 1 << 19  # word positions counted at a time
ENTRIES, BURST = 1_000_000, 4096  # entries of a trie before it spills; of a container before it bursts
ID_BITS = 21  # of a word id: three ids share a packed key
WORD_BITS, PAIR_BITS = 24, 26  # log2 of the bits of the bitmaps: 2 and 8 MiB
_END = b"\xff"  # a byte that UTF-8 text never holds

_table = bytearray(range(256))
for _c in string.ascii_uppercase.encode():
    _table[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _table[_c] = _END[0]
TABLE = bytes(_table)


class HatTrie:
    """Counts of windows: a first word id and the packed ids of ``width`` further words (0 where the window is shorter)."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.limit = width, burst
        self.containers: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.nodes: dict[int, dict[int, dict[int, int]]] = {}
        self.low = ID_BITS * (width - 1)  # bits behind the second word

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        if self.nodes:
            deep = np.isin(first, np.fromiter(self.nodes, np.int64, len(self.nodes)))
            second, tail = rest[deep] >> self.low, rest[deep] & ((1 << self.low) - 1)
            for w, s, t in zip(first[deep].tolist(), second.tolist(), tail.tolist(), strict=True):
                self.nodes[w][s][t] += 1
            first, rest = first[~deep], rest[~deep]
        containers = self.containers
        for w, r in zip(first.tolist(), rest.tolist(), strict=True):
            containers[w][r] += 1
        if self.width > 1:
            for w in np.unique(first).tolist():
                if len(containers[w]) > self.limit:
                    self._burst(w)

    def _burst(self, word: int) -> None:
        node: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        mask = (1 << self.low) - 1
        for rest, n in self.containers.pop(word).items():
            node[rest >> self.low][rest & mask] = n
        self.nodes[word] = node

    def sizes(self) -> dict[int, int]:
        """Entries below each first word."""
        return {w: len(c) for w, c in self.containers.items()} | {w: sum(map(len, node.values())) for w, node in self.nodes.items()}

    def cut(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take whole subtrees out: (first word, packed rest, count) of their entries."""
        first, rest, counts = array("q"), array("q"), array("q")
        for w in words:
            before = len(rest)
            if w in self.nodes:
                for second, c in self.nodes.pop(w).items():
                    rest.extend([second << self.low | t for t in c])
                    counts.extend(c.values())
            else:
                c = self.containers.pop(w)
                rest.extend(c)
                counts.extend(c.values())
            first.extend([w] * (len(rest) - before))
        return np.array(first), np.array(rest), np.array(counts)


class Words:
    """Word ids of a task. Words of different langs have different ids; id 0 ends a piece."""

    class Ids(dict):
        def __init__(self, words: Words, lang: str):
            self.words, self.lang = words, lang
            self[_END] = 0

        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self.words.names)
            self.words.names.append(word)
            self.words.langs.append(self.lang)
            return n

    def __init__(self):
        self.names, self.langs = [_END], [""]
        self.of: dict[str, Words.Ids] = {}
        self.hashes = np.zeros(1, np.uint64)

    def ids(self, lang: str, tokens: list[bytes]) -> Iterator[int]:
        if lang not in self.of:
            self.of[lang] = Words.Ids(self, lang)
        return map(self.of[lang].__getitem__, tokens)

    def hashed(self) -> np.ndarray:
        """A 64-bit hash of (lang, word) per id."""
        done = len(self.hashes)
        new = [word_hash(lang, word) for lang, word in zip(self.langs[done:], self.names[done:], strict=True)]
        self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return self.hashes


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode()))


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    x = one * np.uint64(0x9E3779B97F4A7C15) + two
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _holds(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes & np.uint64((1 << bits) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch], words: Callable[[], Words], tokens: int) -> Iterator[tuple[np.ndarray, int]]:
    """(word ids, number of positions to count) of whole texts, each followed by a 0, fewer than ``2 * tokens`` at a time.

    A longer text comes in parts; each also holds the first words of the next, whose positions it does not count.
    """
    ids = array("q")
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
            found = text.as_py().encode().translate(TABLE).replace(_END, b" \xff ").split()
            if len(found) > tokens:
                for at in range(0, len(found), tokens):
                    part = np.fromiter(words().ids(lang, found[at: at + tokens + LONGEST - 1]), np.int64)
                    yield np.append(part, 0), min(tokens, len(found) - at)
                continue
            ids.extend(chain(words().ids(lang, found), (0,)))
            if len(ids) >= tokens:
                yield np.array(ids), len(ids)
                ids = array("q")
    yield np.array(ids, np.int64), len(ids)


PART_BITS = 16  # of a prefix partition's number
RUNS = "part int, gram string, n bigint"  # a gram is a phrase, a tab (no phrase holds one) and the lang; few columns keep the exchange small


def _run(words: Words, columns: list[np.ndarray], counts: np.ndarray, k: int) -> pa.RecordBatch:
    """Rows of phrases given by k columns of word ids."""
    names, h = pa.array(words.names, pa.binary()), words.hashed()
    parts = [names.take(pa.array(c)) for c in columns]
    phrase = pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]
    prefix = (h[columns[0]] ^ (h[columns[1]] & np.uint64(63) if k > 1 else np.uint64(0))) & np.uint64((1 << PART_BITS) - 1)
    langs = pa.array([x.encode() for x in words.langs], pa.binary()).take(pa.array(columns[0]))
    gram = pc.binary_join_element_wise(phrase, langs, b"\t").cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int32)), gram, pa.array(counts)], ["part", "gram", "n"])


def _sorted_run(words: Words, first: np.ndarray, rest: np.ndarray, counts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The entries of whole subtrees in phrase order; shorter phrases are summed over their subtrees."""
    columns = [first, *[rest >> ID_BITS * (width - 1 - j) & ((1 << ID_BITS) - 1) for j in range(width)]]
    rank = np.empty(len(words.names), np.int64)
    rank[pc.array_sort_indices(pa.array(words.names, pa.binary())).to_numpy()] = np.arange(len(words.names))
    rank[0] = -1  # shorter windows first
    order = np.lexsort([rank[c] for c in reversed(columns)])
    columns, counts = [c[order] for c in columns], counts[order]
    for k in range(min(3, width + 1), width + 2):  # pairs alone, or all lengths from three
        real = np.flatnonzero(columns[k - 1])
        if not len(real):
            continue
        heads = [c[real] for c in columns[:k]]
        cut = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in heads], axis=0)))
        yield _run(words, [c[cut] for c in heads], np.add.reduceat(counts[real], cut), k)


def count_words(rows: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """RUNS of single words, and an empty phrase with each lang's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(1, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.arange(1, len(counts))
            if len(ids):
                yield _run(words, [ids], counts[1:], 1)
                total: dict[str, int] = defaultdict(int)
                for lang, n in zip(words.langs[1:], counts[1:].tolist(), strict=True):
                    total[lang] += n
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(total), pa.int32()), pa.array(["\t" + x for x in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["part", "gram", "n"])

        for ids, own in _chunks(batches, lambda: words, tokens):
            seen = np.bincount(ids[:own], minlength=len(words.names))
            seen[: len(counts)] += counts
            counts = seen
            if len(words.names) > ENTRIES:
                yield from flush()
                words, counts = Words(), np.zeros(1, np.int64)
        yield from flush()

    return rows.mapInArrow(run, RUNS)


def count_windows(rows: DataFrame, words_bitmap: Broadcast, pairs_bitmap: Broadcast | None = None, tokens: int = TOKENS, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """RUNS of pairs of frequent words, or with ``pairs_bitmap`` of the windows of three and four that its pairs form."""
    width = 1 if pairs_bitmap is None else LONGEST - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie = Words(), HatTrie(width, burst)
        for ids, own in _chunks(batches, lambda: words, tokens):
            h = words.hashed()
            known = _holds(words_bitmap.value, h, WORD_BITS)
            known[0] = False
            on = known[ids]
            pair = on[:-1] & on[1:]
            if width == 1:
                at = np.flatnonzero(pair[:own])
                trie.add(ids[at], ids[at + 1])
            else:
                at = np.flatnonzero(pair)
                pair[at] = _holds(pairs_bitmap.value, pair_hash(h[ids[at]], h[ids[at + 1]]), PAIR_BITS)
                three = pair[:-1] & pair[1:]
                four = np.append(three[:-1] & three[1:], False)[: len(three)]
                at = np.flatnonzero(three[:own])
                last = np.where(four[at], ids[np.minimum(at + 3, len(ids) - 1)], 0)
                trie.add(ids[at], ids[at + 1] << 2 * ID_BITS | ids[at + 2] << ID_BITS | last)
            sizes = trie.sizes()
            held = sum(sizes.values())
            if len(words.names) + 2 * tokens + LONGEST >= 1 << ID_BITS:  # ids run out: everything is spilled
                yield from _sorted_run(words, *trie.cut(list(sizes)), width)
                words = Words()
            elif held > entries:
                out = []
                for w in sorted(sizes, key=sizes.get, reverse=True):
                    out.append(w)
                    held -= sizes[w]
                    if held <= entries // 2:
                        break
                yield from _sorted_run(words, *trie.cut(out), width)
        yield from _sorted_run(words, *trie.cut(list(trie.sizes())), width)

    return rows.mapInArrow(run, RUNS)


def merged(runs: DataFrame, support: int) -> DataFrame:
    """(lang, k, phrase, n): runs summed in the partition of their prefix; phrases of at least ``support`` occurrences, and the langs' totals with k 0."""
    total = runs.repartition("part").groupBy("part", "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= support) | F.startswith("gram", F.lit("\t")))
    phrase = F.substring_index("gram", "\t", 1)
    lang = F.substring(F.col("gram"), F.length(phrase) + 2, F.length("gram"))
    return total.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("k"), F.nullif(phrase, F.lit("")).alias("phrase"), "n")


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits hash bits of the phrases of one or two words: at most 2 ** (bits - 15) rows of 4 KiB reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [p.encode().split(b" ") for p in b["phrase"].to_pylist()]
            each = [np.array([word_hash(lang, p[i]) for lang, p in zip(b["lang"].to_pylist(), split, strict=True)], np.uint64) for i in range(len(split[0]) if split else 0)]
            h = (each[0] if len(each) == 1 else pair_hash(*each)) if each else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64((1 << bits) - 1)).astype(np.int64))], ["at"])

    at = grams.select("lang", "phrase").mapInArrow(run, "at bigint")
    pieces = at.groupBy(F.shiftright("at", 15).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(max(1 << (bits - 3), 1 << 12), np.uint8)
    for r in pieces.toLocalIterator():
        out[r.piece << 12: (r.piece + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def frequent(df: DataFrame, lang_col="lang", text_col="text", support: int = SUPPORT, tokens: int = TOKENS, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """(lang, k, phrase, n): all phrases of one to four words with at least ``support`` occurrences; with k 0 and a null phrase the lang's number of words."""
    spark = df.sparkSession
    rows = pick(df, lang=lang_col, text=text_col).na.fill({"lang": "und", "text": ""})
    words = stored(merged(count_words(rows, tokens), support), "words")
    in_words = spark.sparkContext.broadcast(bitmap(words.where("k = 1"), WORD_BITS))
    pairs = stored(merged(count_windows(rows, in_words, None, tokens, entries, burst), support), "word_pairs")
    in_pairs = spark.sparkContext.broadcast(bitmap(pairs, PAIR_BITS))
    longer = stored(merged(count_windows(rows, in_words, in_pairs, tokens, entries, burst), support), "longer")
    return words.unionByName(pairs).unionByName(longer)


def collocations(df: DataFrame, lang_col="lang", text_col="text", support: int = SUPPORT, top: int = TOP, inside: int = INSIDE, **sizes: int) -> DataFrame:
    """lang, rank, phrase, words, a, cut, l, r, n, score: each lang's best phrases of two to four words.

    The score is the lowest of ``floor(2000000 * a / (l + r))`` over the cuts of the phrase, ``cut``
    the first that has it. Candidates that lie inside a longer candidate with at least ``inside``
    percent of their occurrences are dropped. Null lang counts as ``und``, null text as empty; rows
    that repeat count as often as they occur. Ties go by occurrences, then by phrase in UTF-8 order. An
    empty table, or one without a frequent phrase, gives an empty result.
    """
    grams = frequent(df, lang_col, text_col, support, **sizes)
    found = grams.where("k >= 2").withColumnRenamed("n", "a")
    cuts = found.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    known = grams.where("k between 1 and 3")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", wide, (F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")))
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    w = F.split("phrase", " ")
    parts = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    within = found.where("k >= 3").withColumn("w", w).select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = grams.where("k = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("k").alias("words"), "a", "best.cut", "best.l", "best.r", "n", "best.score")


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k) GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND n >= {SUPPORT}),
u AS (SELECT c.*, unnest(range(1, k)) AS j FROM c),
s AS (SELECT u.lang, u.phrase, u.k, u.w, a, j, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score
      FROM u JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:j], ' ') JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS f FROM c, (VALUES (2), (3)) AS v(m) WHERE m < k),
x AS (SELECT lang, array_to_string(w[f:f + m - 1], ' ') AS phrase, max(a) AS longer FROM i GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {INSIDE} * a)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}
"""


@llm_query("op13_phrase_collocations", SQL)
def op13_phrase_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir)).drop("words", "cut")
