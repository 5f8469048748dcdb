"""Exact order statistics by radix selection: no sort and no exchange of values.

A double's bits, flipped so that they order like the numbers, are counted by their first 16 bits
per (group, column). Only the buckets that hold a wanted rank are counted again by further bits,
until the bits are the value: two to four passes over the data, whatever its size, each of which
exchanges counts. Many columns and many ranks share the passes.

For groups that are as few as features, classes or folds: the wanted buckets (one per group, column
and rank) are told to the tasks. ``ranking.quantiles`` serves any number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 16  # bits per pass
FINISH = 1 << 16  # a bucket of so few values is finished in one pass
FIRST = (1 << STEP) + 1  # digits of the first pass: nulls, then the first bits
_TOP = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """64-bit integers that order like the doubles; -0.0 equals 0.0."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_bits(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _TOP, bits ^ _TOP, ~bits).view(np.float64)[0])


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values (columns, rows), and whether they are null."""
    null = np.stack([batch[c].is_null().to_numpy(zero_copy_only=False) for c in columns])
    return np.stack([batch[c].fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in columns]), null


def _groups(batch: pa.RecordBatch, group: list[str]) -> tuple[np.ndarray, list[int], list[tuple]]:
    """Code of each row's group, a row of each code, and its values."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in group:
        each = batch[c].dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(each.dictionary) + each.indices.to_numpy(), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    names = [batch[c].take(pa.array(first)).to_pylist() for c in group]
    return code, first.tolist(), [tuple(n[i] for n in names) for i in range(len(first))]


def _count(rows: DataFrame, group: list[str], columns: list[str], wanted: dict | None) -> DataFrame:
    """(group, col, prefix, digit, n): counts by the next bits inside the wanted prefixes; digit -1 counts nulls in the first pass.

    ``wanted`` maps (group, col) to (prefix, its bits, next bits) lists; without it the first bits of all values are counted.
    """
    types = dict(rows.dtypes)
    schema = "".join(f"`{g}` {types[g]}, " for g in group) + "col int, prefix bigint, digit bigint, n bigint"
    names = [*group, "col", "prefix", "digit", "n"]

    def rows_of(batch, first, code, col, prefix, digit, n):
        at = pa.array(np.array(first, np.int64)[code])
        return pa.RecordBatch.from_arrays([*[batch[g].take(at) for g in group], pa.array(col.astype(np.int32)), pa.array(prefix), pa.array(digit), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, first, values = _groups(b, group)
            x, null = _matrix(b, columns)
            keys, real = ordered_bits(x), ~np.isnan(x)
            if wanted is None:
                col = np.repeat(np.arange(len(columns)), b.num_rows).reshape(x.shape)
                digit = np.where(null, -1, (keys >> np.uint64(64 - STEP)).astype(np.int64))
                use = real | null
                packed = ((col * len(first) + code[None, :]) * FIRST + digit + 1)[use]
                packed, n = np.unique(packed, return_counts=True)
                cell, digit = packed // FIRST, packed % FIRST - 1
                yield rows_of(b, first, cell % len(first), cell // len(first), np.zeros(len(n), np.int64), digit, n)
                continue
            for g, value in enumerate(values):
                mine = code == g
                for c in range(len(columns)):
                    for prefix, done, more in wanted.get((value, c), ()):
                        k = keys[c][mine & real[c]]
                        k = k[k >> np.uint64(64 - done) == np.uint64(prefix)]
                        digit, n = np.unique(k >> np.uint64(64 - done - more) & np.uint64((1 << more) - 1), return_counts=True)
                        if len(n):
                            size = len(n)
                            yield rows_of(b, first, np.full(size, g), np.full(size, c), np.full(size, prefix, np.int64), digit.astype(np.int64), n)

    # a prefix may fill 48 bits, a digit 48
    return rows.mapInArrow(run, schema).groupBy(*group, "col", "prefix", "digit").agg(F.sum("n").alias("n"))


def order_stats(df: DataFrame, group, columns, ranks: dict[str, Column]) -> dict[tuple, dict]:
    """{(group values, column): {"n", "missing", name: value}} for 0-based ranks given in terms of ``n`` and ``missing``.

    n counts values, missing counts nulls; NaN is neither. A rank outside 0 .. n - 1 gives None.
    """
    group, columns = list(group), list(columns)
    rows = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns])
    cell = [*group, "col"]
    counts = _count(rows, group, columns, None)
    part = Window.partitionBy(*cell)
    run = part.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    real = F.when(F.col("digit") >= 0, F.col("n")).otherwise(0)
    placed = counts.withColumns({
        "_all": F.sum(real).over(part), "missing": F.sum(F.when(F.col("digit") < 0, F.col("n")).otherwise(0)).over(part),
        "before": F.coalesce(F.sum(real).over(run), F.lit(0)), "in_bucket": real}).withColumn("n", F.col("_all"))
    wishes = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    hits = F.filter(wishes, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("in_bucket")))
    # one row per bucket that holds a rank, and the bucket of nulls or the first one for the totals
    seen = placed.select(*cell, "digit", "in_bucket", "before", "n", "missing", hits.alias("hits"), F.row_number().over(part.orderBy("digit")).alias("_i")).where((F.size("hits") > 0) | (F.col("_i") == 1)).collect()
    out: dict[tuple, dict] = {}
    open_: dict[tuple, list] = {}  # (group, col): [name, rank inside, prefix, bits, rows of the bucket]
    for r in seen:
        key = (tuple(r[g] for g in group), r["col"])
        out.setdefault(key, {"n": r.n, "missing": r.missing} | dict.fromkeys(ranks))
        open_.setdefault(key, []).extend([h["name"], h["rank"] - r.before, r.digit, STEP, r.in_bucket] for h in r.hits)
    while any(open_.values()):
        wanted = {}
        for key, items in open_.items():
            size = {(prefix, bits): n for _, _, prefix, bits, n in items}
            wanted[key] = [(prefix, bits, 64 - bits if n <= FINISH else STEP) for (prefix, bits), n in size.items()]
        counts = _count(rows, group, columns, wanted)
        part = Window.partitionBy(*cell, "prefix")
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(part.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        by = {(key, prefix): (bits, more) for key, items in wanted.items() for prefix, bits, more in items}
        need = {}
        for key, items in open_.items():
            for name, rank, prefix, _, _ in items:
                need.setdefault((key, prefix), []).append((name, rank))
        spark = df.sparkSession
        schema = ", ".join([*[f"`{g}` {dict(rows.dtypes)[g]}" for g in group], "col int", "prefix bigint", "ranks array<bigint>"])
        local = spark.createDataFrame([(*key[0], key[1], prefix, sorted({k for _, k in items})) for (key, prefix), items in need.items()], schema)
        same = [placed[g].eqNullSafe(local[g]) for g in cell] + [placed["prefix"] == local["prefix"]]
        inside = F.filter(local["ranks"], lambda k: (k >= placed["before"]) & (k < placed["before"] + placed["n"]))
        found = placed.join(F.broadcast(local), same).select(*[placed[c] for c in cell], placed["prefix"], "digit", "n", "before", inside.alias("hits")).where(F.size("hits") > 0)  # one row per wanted rank is broadcast
        then: dict[tuple, list] = {}
        for r in found.collect():
            key = (tuple(r[g] for g in group), r["col"])
            bits, more = by[key, r.prefix]
            longer = r.prefix << more | r.digit
            for name, rank in need[key, r.prefix]:
                if rank in r.hits:
                    if bits + more == 64:
                        out[key][name] = from_bits(longer)
                    else:
                        then.setdefault(key, []).append([name, rank - r.before, longer, bits + more, r.n])
        open_ = then
    return {(g, columns[c]): v for (g, c), v in out.items()}


def quantile_ranks(names: dict[str, float]) -> dict[str, Column]:
    """The two ranks that each quantile interpolates between."""
    n = F.col("n")
    low = {k: F.floor((n - 1) * F.lit(float(q))) for k, q in names.items()}
    return {f"{k}.lo": v for k, v in low.items()} | {f"{k}.hi": F.least(v + 1, n - 1) for k, v in low.items()}


def interpolated(low: float | None, high: float | None, n: int, q: float) -> float | None:
    """Linear interpolation between the ranks below and above ``(n - 1) q``."""
    if low is None:
        return None
    h = (n - 1) * q
    return low + (high - low) * (h - math.floor(h))


def quantiles_by_column(df: DataFrame, group, columns, names: dict[str, float]) -> dict[tuple, dict]:
    """{(group values, column): {"n", "missing", name: quantile}}."""
    found = order_stats(df, group, columns, quantile_ranks(names))
    return {key: {"n": s["n"], "missing": s["missing"]} | {k: interpolated(s[f"{k}.lo"], s[f"{k}.hi"], s["n"], q) for k, q in names.items()} for key, s in found.items()}


def quantiles(df: DataFrame, group, value: str, names: dict[str, float]) -> DataFrame:
    """(group, n, names) as a small table; groups without a value are left out."""
    group = list(group)
    found = quantiles_by_column(df, group, [value], names)
    schema = ", ".join([*[f"`{g}` {t}" for g, t in df.select(*group).dtypes], "n bigint", *[f"`{k}` double" for k in names]])
    return df.sparkSession.createDataFrame([(*g, s["n"], *[s[k] for k in names]) for (g, _), s in found.items() if s["n"]], schema)


def filled_stats(df: DataFrame, columns, names: dict[str, float], empty: float = 0.0) -> dict[str, dict]:
    """Per column ``fill`` (the median, ``empty`` without values), and the order statistics around each quantile after filling.

    Filling puts copies of the median between the values, so the k-th filled value is the middle
    one of the values of rank ``k - missing`` and ``k`` and the median: no second pass is needed.
    """
    n, miss = F.col("n"), F.col("missing")
    size = n + miss
    low = {k: F.floor((size - 1) * F.lit(float(q))) for k, q in names.items()}
    ranks = quantile_ranks({"fill": 0.5})
    for k, v in low.items():
        for end, rank in (("lo", v), ("hi", F.least(v + 1, size - 1))):
            ranks[f"{k}.{end}"], ranks[f"{k}.{end}.down"] = rank, rank - miss
    out = {}
    for (_, c), s in order_stats(df, [], columns, ranks).items():
        fill = interpolated(s["fill.lo"], s["fill.hi"], s["n"], 0.5)
        fill = empty if fill is None else fill

        def middle(name: str, s=s, fill=fill) -> float:
            up, down = s[name], s[f"{name}.down"]
            return max(-math.inf if down is None else down, min(math.inf if up is None else up, fill))

        out[c] = {"fill": fill, "n": s["n"] + s["missing"]} | {f"{k}.{end}": middle(f"{k}.{end}") for k in names for end in ("lo", "hi")}
    return out
