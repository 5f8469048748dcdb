"""Isotonic calibration from mergeable hulls.

The rising fit is the slope of the lower convex hull of the points (cumulated weight, cumulated
sum) in order of the score. A stretch of scores can be replaced by the blocks of its own hull, and
hulls of neighbouring stretches merge into the hull of both, so the scores are cut into ranges,
every range keeps its blocks, and blocks meet in rounds until one hull per group is left. With 0/1
labels a stretch of n rows has at most about n ** (2/3) blocks. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diurna.operators.ranking import MOST, PER_RANGE, row_ranges, with_ranges

FAN = 32  # ranges whose hulls meet in one task of a round


def _pooled(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The hull of the blocks of each (key, _range): neighbours whose mean does not rise are one block."""
    dealt = [*key, "_range"]
    columns = [*dealt, "low", "high", "w", "s"]
    rows = blocks.select(columns).repartition(*dealt).sortWithinPartitions(*dealt, "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hull, schema = None, [], None

        def closed() -> pa.RecordBatch:
            ends = [list(c) for c in zip(*hull, strict=True)]
            arrays = [pa.array([v] * len(hull), schema.field(i).type) for i, v in enumerate(now)]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, pa.float64()) for c in ends]], columns)

        for b in batches:
            schema = b.schema
            values = [b[c].to_pylist() for c in columns]
            for row in zip(*values, strict=True):
                at = row[:len(dealt)]
                if at != now:
                    if hull:
                        yield closed()
                    now, hull = at, []
                low, high, w, s = row[len(dealt):]
                while hull and hull[-1][3] * w >= s * hull[-1][2]:  # the mean before is not smaller
                    low, _, w0, s0 = hull.pop()
                    w, s = w + w0, s + s0
                hull.append((low, high, w, s))
        if hull:
            yield closed()

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns))


def isotonic_blocks(train: DataFrame, key, score: str, label: str, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """(key, low, high, w, value): the fit is ``value`` from score ``low`` to ``high``; values rise.

    Rows without score (null, NaN) or label do not take part.
    """
    key = list(key)
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = train.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull()).select(*key, (x + F.lit(0.0)).alias("low"), y.alias("_y"))
    distinct = rows.groupBy(*key, "low").agg(F.count("*").cast("double").alias("w"), F.sum("_y").alias("s"))
    blocks = _pooled(with_ranges(distinct, key, "low", ["w", "s"], per_range, most).withColumn("high", F.col("low")), key)
    left = most
    while left > 1:
        left = -(-left // FAN)
        blocks = _pooled(blocks.withColumn("_range", F.floor(F.col("_range") / FAN).cast("int")), key)
    return blocks.select(*key, "low", "high", "w", (F.col("s") / F.col("w")).alias("value"))


def interpolated(points: DataFrame, test: DataFrame, key, score: str, out: str, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Test rows with the value at their score: linear between ``points(key, _x, _v)``, constant beyond them, null without any.

    Points and rows are dealt together by score range; the last point before a range and the first
    after it come from the ranges' summaries.
    """
    key = list(key)
    names = test.columns
    x = F.col(score).cast("double")
    usable = x.isNotNull() & ~F.isnan(x)
    both = test.where(usable).withColumns({"_x": x + F.lit(0.0), "_v": F.lit(None).cast("double")}).unionByName(points.select(*key, "_x", "_v"), allowMissingColumns=True)
    both = both.withColumn("_is", F.col("_v").isNull())
    dealt = row_ranges(both, key, "_x", per_range, most).withColumn("_p", F.when(~F.col("_is"), F.struct("_x", "_v")))
    part = Window.partitionBy(*key, "_range", "_salt").orderBy("_x")
    inside = dealt.withColumns({
        "_before": F.last("_p", ignorenulls=True).over(part.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "_after": F.first("_p", ignorenulls=True).over(part.rangeBetween(Window.currentRow, Window.unboundedFollowing))})
    own = dealt.groupBy(*key, "_range").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    over = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_range")
    edge = own.select(*key, "_range", "_low", F.last("_high", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
                      F.first("_low", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
    same = [inside[c].eqNullSafe(edge[c]) for c in [*key, "_range"]]
    met = inside.where("_is").join(edge, same)
    single = F.when(inside["_range"] % 2 == 1, F.col("_low"))  # one score only: its point may lie in another salt
    a, b = F.coalesce(single, "_before", "_left"), F.coalesce(single, "_after", "_right")
    d = met.select(*[inside[c] for c in names], inside["_x"], a.alias("_a"), b.alias("_b"))
    rise = (F.col("_b._v") - F.col("_a._v")) * (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    value = F.when(F.col("_a").isNull(), F.col("_b._v")).when(F.col("_b").isNull() | (F.col("_a._x") == F.col("_b._x")), F.col("_a._v")).otherwise(F.col("_a._v") + rise)
    return d.select(*names, value.alias(out)).unionByName(test.where(~usable | x.isNull()).withColumn(out, F.lit(None).cast("double")))


def isotonic(train: DataFrame, test: DataFrame, score: str, label: str, key=(), per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Test rows with ``calibrated``: the rising fit of each key's train rows, linear between its blocks, constant beyond.

    Null where the score is missing or the key has no train rows.
    """
    blocks = isotonic_blocks(train, key, score, label, per_range, most)
    ends = F.array_distinct(F.array("low", "high"))
    points = blocks.select(*key, F.explode(ends).alias("_x"), F.col("value").alias("_v"))
    return interpolated(points, test, key, score, "calibrated", per_range, most)
