"""URL filters: path rules, then a block list held as a Bloom filter cascade (DataFrame functions only).

Level 0 is a Bloom filter over the listed keys. The keys of the corpus that pass it without being
listed are its false positives; level 1 is a filter over exactly these, level 2 over the listed keys
that level 1 passes by mistake, and so on in turns until a level passes nothing wrongly. As every
key that the corpus can ask took part, the first level that lacks a key tells for certain whether
it is listed, so urls are judged in the scan, without a join and without an exchange.

A filter is one array of 64-bit words, made by ``bit_or`` over bit positions and read by a scalar
subquery. Its size depends on the list (about 1.5 bits per hash and key), not on the corpus, and is
checked against ``limit`` before it is built; a longer list is joined instead, which is exact too.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm.frames import pick, stored
from diurna.llm.registry import llm_query

LIMIT = 1 << 27  # bits of one filter: 16 MiB
MOST, LATER = 32, 4  # hashes of the first level at most; hashes of the others
NAMES = 127  # labels that a host name can have
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
# Parts of a label that put a name on the list.
WORDS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "pharma", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "xxx")


def parsed(df: DataFrame, id_col="page_id", url_col="url") -> DataFrame:
    """page_id, url, host (A-Z lower-cased) and path; both empty without ``://``."""
    rows = pick(df, page_id=id_col, url=url_col)
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return rows.select("page_id", "url", host.alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def best_rule(rules, of) -> Column:
    """``of(rule)`` of the longest rule that fits, of the longer host on ties; else null."""
    host, path = F.col("host"), F.col("path")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in order]
    return F.coalesce(*[F.when(f, F.lit(of(r))) for f, r in zip(fits, order, strict=True)], F.lit(None).cast("string"))


def keys(depths) -> dict[str, Column]:
    """The keys that a url asks: its host, the host's last ``d`` labels for each depth, host and path. Null where there is none."""
    host = F.when(F.col("host") != "", F.col("host"))
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    out = {f"name{d}": F.when(labels > d, F.substring_index(host, ".", -d)) for d in depths}
    return {"host": host, **out, "page": F.when(F.col("path") != "", F.concat(host, F.col("path")))}


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: DataFrame  # one row, one array

    def places(self, key: Column) -> list[Column]:
        """Bit positions of a key: double hashing, another seed per level."""
        h = F.xxhash64(F.lit(self.number), key)
        low = h.bitwiseAND(F.lit(0x7FFFFFFF))
        step = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
        return [(low + step * F.lit(j)).bitwiseAND(F.lit(self.bits - 1)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()

        def on(place: Column) -> Column:
            return F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

        return reduce(lambda a, b: a & b, [on(p) for p in self.places(key)])


def level(spark: SparkSession, members: DataFrame, n: int, number: int, hashes: int) -> Level:
    """Filter over ``members(key)``, ``n`` rows, written to the shared folder."""
    bits = 1 << max(6, ceil(log2(max(n, 1) * hashes * 1.4427)))
    made = Level(number, bits, hashes, members)
    place = members.select(F.explode(F.array(*made.places(F.col("key")))).alias("place"))
    ones = place.select(F.shiftright("place", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
    zeros = spark.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    each = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = each.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    return Level(number, bits, hashes, stored(row, f"bloom{number}"))


@dataclass(frozen=True)
class Cascade:
    """Levels that decide membership for every key of the corpus they were built over."""

    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """True for listed keys, False for the others and for null."""
        answer = F.lit(len(self.levels) % 2 == 1)  # a key that passes every level belongs to the last one's members
        for lv in reversed(self.levels):
            answer = F.when(~lv.passes(key), F.lit(lv.number % 2 == 1)).otherwise(answer)
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def cascade(spark: SparkSession, listed: DataFrame, asked: DataFrame, n_listed: int, first_hashes: int | None = None, later: int = LATER) -> Cascade:
    """Cascade over ``listed(key)`` (distinct) that is exact for every key of ``asked(key)`` (repeats do no harm).

    The corpus is read twice: for an estimate of its number of keys, which sets the first level's
    hashes, and for the first level's false positives; only these are exchanged.
    """
    if not n_listed:
        return Cascade(())
    if first_hashes is None:
        others = asked.agg(F.approx_count_distinct("key")).first()[0]
        first_hashes = min(MOST, max(later, ceil(log2(max(others / n_listed, 2)))))
    levels = [level(spark, listed, n_listed, 0, first_hashes)]
    passed = asked.where(F.col("key").isNotNull() & levels[0].passes(F.col("key"))).distinct()
    inside, outside = listed, stored(passed.join(listed, "key", "left_anti"), "passed0")
    n = outside.count()
    while n:
        if len(levels) > 64:
            raise ValueError("two keys agree in all hashes")
        levels.append(level(spark, outside, n, len(levels), later))
        inside, outside = outside, stored(inside.where(levels[-1].passes(F.col("key"))), f"passed{len(levels) - 1}")
        n = outside.count()
    return Cascade(tuple(levels))


def filtered(df: DataFrame, listed: DataFrame, id_col="page_id", url_col="url", key_col="key", rules=RULES, limit: int = LIMIT) -> DataFrame:
    """One row per input row: page_id, host, path, rule (text of the longest rule that fits, else null), listed, verdict.

    ``listed`` holds names, which stand for themselves and all subdomains, and host and path of
    single pages. ``verdict`` is the rule's, else ``block`` for listed urls and ``allow`` for the
    others. Null urls and urls without ``://`` ask nothing and are allowed; null, empty and repeated
    list entries count once or not at all; an empty list blocks nothing beside the rules. Names of
    over 127 labels stand for themselves only. Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = parsed(df, id_col, url_col)
    names = stored(pick(listed, key=key_col).where("key <> ''").distinct(), "listed")
    shape = names.agg(F.count("*").alias("n"), F.collect_set(F.when(~F.contains("key", F.lit("/")), F.least(F.size(F.split("key", r"\.")), F.lit(NAMES + 1)))).alias("d")).first()
    asks = keys(sorted(d for d in shape.d if d <= NAMES))
    asked = rows.select(F.explode(F.array(*asks.values())).alias("key")).where("key is not null")
    rule, verdict = best_rule(rules, lambda r: r.text), best_rule(rules, lambda r: r.verdict)
    if shape.n * MOST * 3 <= limit:  # bits are rounded up to a power of two
        held = cascade(spark, names, asked, shape.n)
        rows = rows.withColumn("listed", reduce(lambda a, b: a | b, [held.has(k) for k in asks.values()]))
    else:  # a list too long to hold in memory: equality join, by url
        hit = rows.select("url", F.explode(F.array(*asks.values())).alias("key")).join(names, "key", "left_semi").select(F.col("url").alias("hit")).distinct()
        hit = stored(hit, "hits")
        rows = rows.join(hit, F.col("url") == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull())
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def suspects(df: DataFrame, url_col="url", words=WORDS) -> DataFrame:
    """key: the names in the corpus' hosts whose first label has one of the words between hyphens."""
    rows = parsed(df, url_col, url_col).select("host").distinct().where("host <> ''")
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    return rows.select(F.explode(names).alias("key")).distinct().where(F.col("key").rlike(rf"^([^.]*-)?({'|'.join(words)})(-[^.]*)?(\.|$)"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in order]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, order, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, order, strict=True))
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                  regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN regexp_matches(host, '(^|[.])([^.]*-)?({'|'.join(WORDS)})(-[^.]*)?([.]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


@llm_query("op11_url_filter", _sql())
def op11_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filtered(pages, suspects(pages)).select("page_id", "host", "path", "rule", "verdict")
