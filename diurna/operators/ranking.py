"""Exact order statistics without a single-partition window.

Values are first collapsed to distinct (group, value) rows with map-side partial sums,
then cut into value ranges. A window runs inside each range only, and range totals
(a few dozen rows per group) supply the offsets. A hot group is therefore spread over
many tasks, and the result does not depend on where the ranges are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.numbers import correlation
from diurna.sources.files import materialise

PER_RANGE, MOST = 4096, 512  # rows of a range, and ranges per group at most


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame (always a global aggregate, so its size does not depend on the data)."""
    return df.crossJoin(F.broadcast(row))


def _attach(df: DataFrame, small: DataFrame, group: list[str]) -> DataFrame:
    """Left join of per-group facts; without a group the facts are one row.

    The left join keeps ``df`` from being broadcast: before it has run, its size is only a guess from
    the files. It stays one only if a filter on the facts is inside ``coalesce`` with columns of ``df``.
    """
    return df.join(small, group, "left") if group else df.transform(one_row, small)


def _below(edges: Column, value: Column) -> Column:
    """Number of sorted edges below the value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w <= F.size(edges)) & (F.get(edges, at + w - 1) < value), at + w).otherwise(at))


def _edges(rows: DataFrame, group: list[str], value: str, tag: Column, per_range: int, most: int) -> DataFrame:
    """(group, _edges): sorted cuts, one fewer than the ranges, from a hash sample of about 16 rows per range.

    The cuts must be a function of the data alone: several branches of a plan evaluate them, and an
    approximate percentile depends on the order in which partial sketches happen to be merged.
    """
    size = rows.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_k", F.least(F.lit(most), F.ceil(F.col("_n") / per_range)).cast("int"))
    unit = F.pmod(tag, F.lit(2 ** 32)) / F.lit(float(2 ** 32))
    sample = _attach(rows, size, group).where(F.coalesce((unit * F.col("_n") < 16 * F.col("_k")) & (F.col("_k") > 1), F.lit(False)))
    cut = F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda k: F.get("_s", F.floor(k * F.size("_s") / F.col("_k")).cast("int")))
    return sample.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("_s"), F.max("_k").alias("_k")).select(*group, cut.alias("_edges"))


def with_ranges(d: DataFrame, group: list[str], value: str, sums, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Adds the value range of each distinct row; the number of ranges follows the number of distinct values."""
    # Always true; it only names the sums, so that this branch is not pruned to another
    # aggregation and the exchange of distinct values is computed once for all branches.
    seen = F.abs(F.hash(*sums).cast("bigint")) >= 0
    edges = _edges(d.where(seen).select(*group, value), group, value, F.xxhash64(F.col(value)), per_range, most)
    if group:
        d = d.join(edges, group, "left")
    else:
        d = d.transform(one_row, edges.agg(F.first("_edges").alias("_edges")))
    return d.withColumn("_range", F.coalesce(_below(F.col("_edges"), F.col(value)), F.lit(0))).drop("_edges")


def row_ranges(df: DataFrame, group, value: str, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Adds ``_range`` and ``_salt`` to every row; ``_range`` rises with the value and equal values share it.

    A value that is a cut is a range of its own (odd numbers). One that many rows share is several
    cuts, and its range is dealt over as many salts, so that no value is one task's work. The values
    must be stored or row expressions, as for ``midranks``.
    """
    group = list(group)
    tag = F.xxhash64(*df.columns)
    edges = _edges(df.select(*df.columns), group, value, tag, per_range, most)
    every = edges.select(*group, F.array_distinct("_edges").alias("_cuts"), F.transform(F.array_distinct("_edges"), lambda e: F.size(F.filter("_edges", lambda x: x == e))).alias("_times"))
    d = df.join(every, group, "left") if group else df.transform(one_row, every.agg(F.first("_cuts").alias("_cuts"), F.first("_times").alias("_times")))
    d = d.withColumn("_at", F.coalesce(_below(F.col("_cuts"), F.col(value)), F.lit(0)))
    single = F.coalesce(F.get("_cuts", F.col("_at")) == F.col(value), F.lit(False))
    salt = F.when(single, F.pmod(tag, F.get("_times", F.col("_at")))).otherwise(0)
    return d.select(*df.columns, (2 * F.col("_at") + single.cast("int")).alias("_range"), salt.cast("int").alias("_salt"))


def row_counts(df: DataFrame, group, value: str, flag: str | None = None, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Every row with a value (not null, not NaN) with ``n_below``, ``n_equal`` and ``n_all``: rows of its group, or the sum of their 0/1 ``flag``.

    Rows are dealt once, by value range. Ties never cross a border, so a count is the range's offset
    plus a window inside it; in a range of one value all rows share their counts and need no order.
    """
    group = list(group)
    d = row_ranges(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), group, value, per_range, most)
    key = group if group else [F.lit(0)]
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.col(flag).cast("bigint") if flag else F.lit(1).cast("bigint")
    totals = d.groupBy(*group, "_range").agg(F.sum(unit).alias("_c")).select(
        *group, "_range", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(Window.partitionBy(*key)).alias("n_all"))
    part = [*group, "_range", "_salt"]
    inside = d.withColumns({"_eq": F.sum(unit).over(Window.partitionBy(*part, value)), "_le": F.sum(unit).over(Window.partitionBy(*part).orderBy(value))})
    single = F.col("_range") % 2 == 1
    below = F.col("_off") + F.when(single, 0).otherwise(F.col("_le") - F.col("_eq"))
    return inside.join(totals, [*group, "_range"]).select(*df.columns, below.alias("n_below"), F.when(single, F.col("_c")).otherwise(F.col("_eq")).alias("n_equal"), "n_all")


def row_midranks(df: DataFrame, group, value: str, per_range: int = PER_RANGE, most: int = MOST) -> DataFrame:
    """Every row with a value (not null, not NaN) with its ``midrank`` in the group and the group's ``n``."""
    c = row_counts(df, group, value, None, per_range, most)
    return c.select(*df.columns, (F.col("n_below") + (F.col("n_equal") + 1) / 2).alias("midrank"), F.col("n_all").alias("n"))


def cumulate(df: DataFrame, group, value: str, sums: dict[str, Column], ranges: int = MOST, ranked: bool = False) -> DataFrame:
    """Distinct (group, value) rows with each sum, its running total ``cum_*`` and group total ``tot_*``.

    Null and NaN values are left out. ``ranked`` adds ``cum_seq``, the position of the value among the distinct values, and ``tot_seq``.
    """
    group = list(group)
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*group, value).agg(*[e.alias(k) for k, e in sums.items()])
    d = with_ranges(d, group, value, list(sums), most=ranges)
    part = Window.partitionBy(*group, "_range").orderBy(value)
    run = part.rowsBetween(Window.unboundedPreceding, 0)
    inside = d.withColumns({**{f"cum_{k}": F.sum(k).over(run) for k in sums}, **({"cum_seq": F.row_number().over(part)} if ranked else {})})
    names = [*sums, "seq"] if ranked else list(sums)
    totals = d.groupBy(*group, "_range").agg(*[F.sum(k).alias(k) for k in sums], *([F.count("*").alias("seq")] if ranked else []))
    key = group if group else [F.lit(0)]
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    offsets = totals.select(
        *group, "_range",
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_off_{k}") for k in names],
        *[F.sum(k).over(whole).alias(f"tot_{k}") for k in names])
    out = inside.join(offsets, [*group, "_range"])
    return out.select(
        *group, value, *sums,
        *[(F.col(f"cum_{k}") + F.col(f"_off_{k}")).alias(f"cum_{k}") for k in names],
        *[f"tot_{k}" for k in names])


def quantile_name(q: float) -> str:
    return f"q{q * 100:g}".replace(".", "_")


def quantiles(df: DataFrame, group, value: str, qs, ranges: int = MOST) -> DataFrame:
    """Exact linearly interpolated quantiles per group, columns q25, q50, ..."""
    group = list(group)
    c = cumulate(df, group, value, {"cnt": F.count("*")}, ranges)
    n, first = F.col("tot_cnt"), F.col("cum_cnt") - F.col("cnt")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("cum_cnt")), F.col(value)))

    agg = [F.max(n).alias("n")]
    for q in qs:
        lo = F.floor((n - 1) * F.lit(float(q)))
        agg += [at(lo).alias(f"_lo_{quantile_name(q)}"), at(F.least(lo + 1, n - 1)).alias(f"_hi_{quantile_name(q)}")]
    w = c.groupBy(*group).agg(*agg)

    def blend(q):
        h = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{quantile_name(q)}"), F.col(f"_hi_{quantile_name(q)}")
        return (lo + (hi - lo) * (h - F.floor(h))).alias(quantile_name(q))

    return w.select(*group, "n", *[blend(q) for q in qs])


def midranks(df: DataFrame, group, value: str, ranges: int = MOST) -> DataFrame:
    """Distinct (group, value) rows with the average rank of the ties and the group size.

    To join ranks back by value, the value must be stored or a row expression, not an aggregate
    that a second evaluation may round differently.
    """
    c = cumulate(df, group, value, {"cnt": F.count("*")}, ranges)
    return c.select(*group, value, (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2).alias("midrank"),
                    F.col("tot_cnt").alias("n"))


def ordinal(df: DataFrame, group, order_hex: str, tie: str, out: str = "idx") -> DataFrame:
    """0-based position of each row in the order of a hex digest, per group, plus group size ``n``.

    Digests are uniform, so the first three hex digits cut every group, hot or not,
    into 4096 even pieces; only piece counts are cumulated.
    """
    group = list(group)
    d = df.withColumn("_piece", F.substring(order_hex, 1, 3))
    counts = d.groupBy(*group, "_piece").agg(F.count("*").alias("_c"))
    key = group if group else [F.lit(0)]
    w = Window.partitionBy(*key)
    offsets = counts.select(
        *group, "_piece",
        F.coalesce(F.sum("_c").over(w.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_c").over(w).alias("n"))
    rn = F.row_number().over(Window.partitionBy(*group, "_piece").orderBy(order_hex, tie)) - 1
    return d.withColumn("_rn", rn).join(offsets, [*group, "_piece"]).withColumn(
        out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_rn", "_off", "_piece")


def spearman(df: DataFrame, group, x: str, y: str, min_n: int = 2) -> DataFrame:
    """Rank correlation per group over complete pairs: rho and n."""
    group = list(group)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("_x"), F.col(y).alias("_y"))
    # A computed double may differ in its last bit when a plan branch is evaluated again (sums
    # merge in another order), so the pairs are stored before they are ranked.
    d = materialise(d, "pairs")
    d = row_midranks(d, group, "_x").select(*group, "_y", F.col("midrank").alias("_rx"))
    j = row_midranks(d, group, "_y").select(*group, "_rx", F.col("midrank").alias("_ry"))
    varied = (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry")) & (F.count("*") >= min_n)
    return j.groupBy(*group).agg(F.when(varied, correlation("_rx", "_ry")).alias("rho"), F.count("*").alias("n"))
