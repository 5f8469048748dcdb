"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every row has a 60-bit hash. Per source, words are summed by the top 12 bits; running sums of this
histogram show the bucket in which the budget ends. Rows in lower buckets are taken, rows in
higher ones are not, and only the boundary bucket is summed again by the next 12 bits, until the
boundary is a single row (or rows that share all 60 bits). No rows are sorted and no row order is
kept: a row is in the mix if its hash lies below its source's threshold. As the hash does not
depend on the budget, the mix for a smaller budget is contained in the mix for a larger one.

A target above a source's size takes every row ``floor(target / size)`` times and the rest by
threshold. Rows are placed by (source, bucket), so a source with a third of all rows is spread
over the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.llm.frames import WORD, documents, pick, sketch, stored, text_or_empty
from diurna.llm.registry import llm_query

BITS, LEVELS = 12, 5
CYCLE = (5.0, 2.0, 1.0)
EPOCHS = 3


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def _bucket(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def positions(values: DataFrame, column: str) -> DataFrame:
    """Rank (from 0) of each distinct value, nulls last, without a global window: ranks inside ranges plus range offsets."""
    n = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.asc_nulls_last(column)
    ranged = stored(values.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    counts = ranged.groupBy("part").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before.select("part", "before"), "part").withColumn("position", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sized: DataFrame, cycle=CYCLE, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, each target at most ``epochs`` sizes.

    Weights repeat over the sources in code-point order, null last. The level L with
    sum(min(epochs * size, L * weight)) = budget is found by repeated one-row aggregations: each
    round fixes the sources that are above their limit and shares the rest again.
    """
    sources = positions(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    sources = stored(sources.withColumn("weight", F.element_at(weights, (F.col("position") % len(cycle) + 1).cast("int"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0]
    if total is None:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    budget, level = min(share, float(epochs)) * total, 0.0
    limit = F.col("source_size") * epochs
    while True:
        over = limit <= F.col("weight") * level
        full, open_weight = sources.agg(F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - full) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return sources.select("source", "source_size", F.least(F.col("weight") * level, limit.cast("double")).alias("target"))


def mix(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", cycle=CYCLE, share: float = 1.0, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, source, row_hash, size, source_size, target, copies, taken (copies * size).

    Null text has size 0; such rows belong to the mix like others and take no words. Null sources
    form one source, last in order. Rows that share id and text share the hash: they are taken
    together, so a source made of copies of one row can miss its target by their words. The row at
    the threshold is taken when that brings the source nearer to its target. An empty table gives
    an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col, source=source_col)
    sized = stored(rows.select("doc_id", "source", sketch(F.lit(seed), F.col("doc_id"), F.md5(text_or_empty())).alias("h"), word_count().alias("size")), "sizes")
    goals = targets(sized, cycle, share, epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("bigint"))
    goals = stored(goals.withColumn("budget", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)), "targets")

    active = sized.withColumn("path", F.lit(0).cast("bigint"))
    budgets = goals.select("source", F.lit(0).cast("bigint").alias("path"), "budget")
    parts = []
    for level in range(LEVELS):
        key = ["source", "path"]
        hist = active.groupBy(*key, _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"), (F.min("h") == F.max("h")).alias("single"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.withColumn("before", before)
        h, b = hist.alias("h"), budgets.alias("b")
        state = h.join(b, F.col("h.source").eqNullSafe(F.col("b.source")) & (F.col("h.path") == F.col("b.path"))).select(
            F.col("h.source").alias("s"), F.col("h.path").alias("p"), "bucket", "words", "single", (F.col("budget") - F.col("before")).alias("rest"))
        # 1: whole bucket taken, 0: boundary, -1: none
        nearer = F.when(F.col("rest") * 2 >= F.col("words"), 1).otherwise(-1)
        side = F.when(F.col("rest") >= F.col("words"), 1).when(F.col("rest") <= 0, -1).when(F.col("single"), nearer).otherwise(0)
        state = stored(state.withColumn("side", side), "histogram")
        a, s = active.alias("a"), state.alias("s")
        met = a.join(s, F.col("a.source").eqNullSafe(F.col("s.s")) & (F.col("a.path") == F.col("s.p")) & (_bucket(level) == F.col("bucket")))
        met = met.select("doc_id", "source", "h", "size", "path", "bucket", "side")
        parts.append(met.where("side <> 0").select("doc_id", "source", "h", "size", (F.col("side") > 0).cast("int").alias("extra")))
        edge = state.where("side = 0")
        deeper = F.shiftleft("path", BITS) + F.col("bucket")
        budgets = edge.select(F.col("s").alias("source"), (F.shiftleft("p", BITS) + F.col("bucket")).alias("path"), F.col("rest").alias("budget"))
        if level == LEVELS - 1 or edge.isEmpty():
            break
        active = stored(met.where("side = 0").select("doc_id", "source", "h", "size", deeper.alias("path")), "boundary")
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    c, g = chosen.alias("c"), goals.alias("g")
    out = c.join(g, F.col("c.source").eqNullSafe(F.col("g.source"))).withColumn("copies", F.least(F.col("whole") + F.col("extra"), F.lit(epochs)))
    return out.select("doc_id", F.col("c.source").alias("source"), F.col("h").alias("row_hash"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", cycle=CYCLE, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (0 to ``epochs`` times), with all columns."""
    marks = mix(df, id_col, text_col, source_col, cycle, share, epochs).where("copies > 0").groupBy("doc_id", "source", "row_hash").agg(F.max("copies").alias("copies"))
    marks = marks.withColumnsRenamed({"doc_id": "mark_id", "source": "mark_source"})
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    key, text, source = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col, source_col))
    flat = flat.withColumn("hash", sketch(F.lit(17), key, F.md5(F.coalesce(text, F.lit("")))))
    met = flat.join(marks, (F.col("hash") == F.col("row_hash")) & source.eqNullSafe(F.col("mark_source")) & key.eqNullSafe(F.col("mark_id")))
    repeated = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"c{i}") for i in range(len(df.columns))]).toDF(*df.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(3 * source_size) OVER w, 0)::DOUBLE AS full_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
         3 * source_size / weight AS ratio
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(max((total - full_before) / (all_weight - weight_before)) FILTER (WHERE (total - full_before) / (all_weight - weight_before) <= ratio), max(ratio)) AS level FROM o),
t AS (
  SELECT source, source_size, least(weight * level, 3.0 * source_size) AS target FROM o, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, b.*, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS budget,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS words,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (least(3, whole + CASE WHEN 2 * (budget - (upto - words)) >= words THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""


@llm_query("op1_mixing", SQL)
def op1_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
