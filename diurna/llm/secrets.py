"""Secret scans over a trigram inverted index (DataFrame functions only).

Each rule's regex is turned into a Boolean query: an OR of ANDs of trigrams that every match must
contain. The index holds one posting (trigram, row) for every trigram that some query names; the
postings of a row are intersected by grouping, the rows that satisfy a query are joined back and
verified with the regex itself. Rules without a mandatory trigram scan every row. Trigrams are
looked up in lower case, so the index serves case-insensitive rules too and only ever returns too
many rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.frames import documents, pick, stored, text_or_empty
from diurna.llm.registry import llm_query


@dataclass(frozen=True)
class Rule:
    """A match counts if its whole, or its group ``group``, has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of 24 or more: the same spans as all runs with the short ones dropped
)
# Public token formats.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams; None if some match may have no mandatory trigram."""

    def runs(items) -> list[list[str]]:
        """For each alternative way through, its literal runs (a run ends where the text is not fixed)."""
        ways: list[list[str]] = [[""]]
        for kind, value in items:
            if kind is op.LITERAL:
                options = [[chr(value)]]
            elif kind is op.SUBPATTERN:
                options = runs(value[3])
            elif kind is op.BRANCH:
                options = [w for branch in value[1] for w in runs(branch)]
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                options = [[chr(v)] for _, v in value]
            elif kind is op.MAX_REPEAT and value[:2] == (0, 1):
                options = [[""], *runs(value[2])]
            elif kind is op.MAX_REPEAT and value[0] == value[1] == 1:
                options = runs(value[2])
            else:
                options = [["", ""]]
            if len(ways) * len(options) > 256:  # too many ways: the text counts as not fixed here
                options = [["", ""]]
            ways = [[*w[:-1], w[-1] + o[0], *o[1:]] for w in ways for o in options]
        return ways

    found = {frozenset(r[i:i + 3] for run in way for r in [run.lower()] for i in range(len(r) - 2)) for way in runs(parser.parse(pattern))}
    return None if frozenset() in found else sorted((q for q in found if not any(o < q for o in found)), key=sorted)


def index(rows: DataFrame, rules=RULES) -> DataFrame:
    """Postings (trigram, row): one for each trigram of the rules' queries that a row's text contains."""
    wanted = sorted({t for r in rules for q in trigram_query(r.pattern) or [] for t in q})
    low = rows.select("row", F.lower("text").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return low.select("row", F.explode(hits).alias("trigram")).select("trigram", "row").distinct()


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(row, rules): the rules whose query the row's postings satisfy."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    wanted = sorted({t for q in queries.values() for a in q for t in a})
    if not wanted:
        return postings.select("row", F.array().cast("array<string>").alias("rules")).limit(0)
    met = postings.groupBy("row").agg(*[F.max(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(wanted)])
    has = {t: F.col(f"t{i}") for i, t in enumerate(wanted)}

    def holds(q) -> Column:
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has[t] for t in sorted(a)]) for a in q])

    hits = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return met.select("row", hits.alias("rules")).where(F.size("rules") > 0)


def _lengths(rule: Rule, text: Column, on: Column) -> Column:
    """Array of (gap, hit, part): code points before a match, of the match and of what is measured; gaps and matches alternate."""
    text, pattern = F.when(on, text).otherwise(F.lit("")), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, 0)
    measured = found if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), measured.alias("part"))
    sizes = F.transform(F.slice(zipped, F.lit(1), F.size(found)), lambda x: F.struct(*[F.length(x[c]).alias(c) for c in ("gap", "hit", "part")]))
    return F.when(F.size(found) > 0, sizes)


def scan(df: DataFrame, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (at, rank, kind, end) by start, then rule order.

    Null text counts as empty and has no spans. Rows are told apart by id and text (rows equal in
    both share their postings), so null and repeated ids do no harm. The lengths of gaps and matches
    are added up by a window per row, so the time grows with the number of matches of a text and not
    with its square. An empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    postings = stored(index(rows, rules), "postings")
    found = stored(candidates(postings, rules), "candidates")
    met = rows.join(found.withColumnRenamed("row", "hit"), F.col("row") == F.col("hit"), "left")
    each = []
    for i, r in enumerate(rules):
        on = F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains("rules", r.kind), F.lit(False))
        each.append(F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), _lengths(r, F.col("text"), on).alias("sizes")))
    hits = met.select("doc_id", "row", F.explode(F.filter(F.array(*each), lambda x: x["sizes"].isNotNull())).alias("m"))
    hits = hits.select("doc_id", "row", "m.rank", "m.kind", "m.least", F.posexplode("m.sizes").alias("turn", "size"))
    one = hits.repartition("row").dropDuplicates(["row", "doc_id", "rank", "turn"])
    upto = F.sum(F.col("size.gap") + F.col("size.hit")).over(Window.partitionBy("row", "doc_id", "rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    placed = one.withColumn("end", upto.cast("bigint")).where(F.col("size.part") >= F.col("least"))
    span = F.struct((F.col("end") - F.col("size.hit")).cast("bigint").alias("at"), "rank", "kind", "end")
    spans = placed.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    a, b = rows.select("doc_id", "row").alias("a"), spans.alias("b")
    none = F.array().cast("array<struct<at:bigint,rank:int,kind:string,end:bigint>>")
    return a.join(b, (F.col("a.row") == F.col("b.row")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select(F.col("a.doc_id").alias("doc_id"), F.coalesce("b.spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [number(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same spans from DuckDB: gaps and matches alternate."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("(?i)", "").replace("'", "''")
        flags = ", 'i'" if "(?i)" in r.pattern else ""
        group = f"regexp_extract_all(t, '{p}', {r.group}{flags})"
        split = f"string_split_regex(t, '{p}'{flags})"
        parts.append(f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {split} AS g, regexp_extract_all(t, '{p}', 0{flags}) AS m, {group} AS part, {r.least} AS least FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
u AS (SELECT doc_id, rank, kind, least, m[k] AS hit, part[k] AS body,
             list_sum(list_transform(g[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)::BIGINT AS pos
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM a WHERE len(m) > 0)),
s AS (SELECT doc_id, rank, kind, pos, kind || ':' || pos || ':' || (pos + length(hit)) AS span FROM u WHERE length(body) >= least),
r AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY pos, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY pos, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)"""


@llm_query("op5_secret_scan", _sql())
def op5_secret_scan(spark, sf_dir):
    return digest(scan(documents(spark, sf_dir)))
