"""Bootstrap draws, subsamples and permutations whose cost in the shuffle does not depend on their number.

A unit's weight in a draw is a function of (seed, unit, draw), so every task makes the weights of
its own rows, as a vector over the draws, and only sums of such vectors leave it. The bootstrap is
the Poisson one: weights are independent Poisson(1) counts, which needs no exchange of slots.

Sums over rows add up as they are. The AUC needs an order: rows are dealt once by value ranges, each
range yields its positives, negatives and concordant pairs per draw, and prefix sums of the
negatives over the ranges (vectors again) join the ranges. All of this is integer arithmetic, so
the result does not depend on where the ranges are cut.

A permutation is a keyed Feistel network on the units' positions with cycle walking: a bijection
that every row evaluates for itself. With the positives in the first positions, a row's permuted
label is a comparison, and the null distribution of the AUC is a sum of midranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.hashing import seeded_md5
from diurna.operators.ranking import one_row, ordinal, row_midranks, row_ranges

GOLDEN, FACTOR = 2654435761, 73244475  # of the integer mixer
ROUNDS = 4  # of the Feistel network
BLOCK = 256  # rows whose weights are in memory at once


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 32-bit values."""
    x = x.astype(np.uint32)
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(FACTOR)
    return x ^ (x >> np.uint32(16))


def poisson_steps() -> list[int]:
    """16-bit limits: a weight is the number of limits not above the hash bits."""
    steps, total, k = [], 0.0, 0
    while not steps or steps[-1] < 65535:
        total += math.exp(-1) / math.factorial(k)
        steps.append(min(65536, int(total * 65536)))
        k += 1
    return [s for s in steps if s < 65536]


def subsample_steps(share: float) -> list[int]:
    """One limit: weight 1 with probability ``share``."""
    return [65536 - round(share * 65536)]


def unit_hash(seed: int, unit: str) -> list[Column]:
    """Two 32-bit halves of a unit's seeded md5, as columns ``_h1`` and ``_h2``."""
    h = seeded_md5(seed, F.col(unit))
    return [F.conv(F.substring(h, at, 8), 16, 10).cast("bigint").alias(name) for at, name in ((1, "_h1"), (9, "_h2"))]


def draw_weights(h1: np.ndarray, h2: np.ndarray, draws: int, steps: list[int]) -> np.ndarray:
    """(rows, draws) of weights."""
    table = np.searchsorted(np.array(steps), np.arange(65536), side="right").astype(np.uint8)
    shift = np.arange(1, draws + 1, dtype=np.uint32) * np.uint32(GOLDEN)
    x = mixed(h1.astype(np.uint32)[:, None] + shift[None, :])
    return table[mixed(x ^ h2.astype(np.uint32)[:, None]) >> np.uint32(16)]


def _key_codes(batch: pa.RecordBatch, key: list[str]) -> tuple[np.ndarray, list[int]]:
    """Code of each row's key, and a row that holds each code's key."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in key:
        values = pc.dictionary_encode(batch[c], null_encoding="encode")
        code = code * len(values.dictionary) + values.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first.tolist()


def _ddl(df: DataFrame, key: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in key)


def _summed(parts: DataFrame, key: list[str], names: list[str], kind: str) -> DataFrame:
    """(key, draw, names): arrays over the draws, exploded and added up. As many rows as tasks and ranges make, times the draws."""
    long = parts.select(*key, F.posexplode(F.arrays_zip(*names)).alias("draw", "_v")).select(*key, "draw", *[F.col(f"_v.{n}").alias(n) for n in names])
    return long.groupBy(*key, "draw").agg(*[F.sum(n).cast(kind).alias(n) for n in names])


def draw_sums(df: DataFrame, key, unit: str, values: dict[str, Column], draws: int, seed: int, steps: list[int] | None = None) -> DataFrame:
    """(key, draw, names): weighted sums of ``values`` (null counts as 0) for every draw.

    Inside a batch the sums are one product of the units' weights and a (unit, key) matrix. A key
    and draw in which every weight is 0 has sum 0. Null units are one unit.
    """
    key, names, steps = list(key), list(values), steps or poisson_steps()
    rows = df.select(*key, *unit_hash(seed, unit), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, first = _key_codes(b, key)
            h = b["_h1"].to_numpy() << 32 | b["_h2"].to_numpy()
            units, at = np.unique(h, return_inverse=True)
            sums = np.zeros((len(names), len(first), draws))
            for lo in range(0, len(units), BLOCK):
                hi = min(lo + BLOCK, len(units))
                rows_in = np.flatnonzero((at >= lo) & (at < hi))
                w = draw_weights(units[lo:hi] >> 32, units[lo:hi] & 0xFFFFFFFF, draws, steps).astype(float)
                for i, n in enumerate(names):
                    matrix = np.zeros((len(first), hi - lo))
                    np.add.at(matrix, (code[rows_in], at[rows_in] - lo), b[n].to_numpy()[rows_in])
                    sums[i] += matrix @ w
            keys = [b[k].take(pa.array(first)) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(list(s), pa.list_(pa.float64())) for s in sums]], [*key, *names])

    parts = rows.mapInArrow(run, _ddl(rows, key) + ", ".join(f"{n} array<double>" for n in names))
    return _summed(parts, key, names, "double")


class _Range:
    """Positives, negatives and twice the concordant pairs of one value range, per draw; rows come in order of the score."""

    def __init__(self, draws: int, single: bool):
        self.single = single
        self.pos, self.neg, self.pairs = (np.zeros(draws, np.int64) for _ in range(3))
        self.score, self.tie_pos, self.tie_neg = None, None, None

    def close(self) -> None:
        """Add the rows of the last score, which wait for their ties."""
        if self.score is not None:
            self.pairs += self.tie_pos * (2 * self.neg + self.tie_neg)
            self.pos += self.tie_pos
            self.neg += self.tie_neg
            self.score = None

    def add(self, score: np.ndarray, label: np.ndarray, w: np.ndarray) -> None:
        if self.single:  # one value only: its ties are paired when all its parts are together
            self.pos += w[label].sum(0, dtype=np.int64)
            self.neg += w[~label].sum(0, dtype=np.int64)
            return
        cut = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        pos = np.add.reduceat(np.where(label[:, None], w, 0), cut, axis=0, dtype=np.int64)
        neg = np.add.reduceat(np.where(label[:, None], 0, w), cut, axis=0, dtype=np.int64)
        if self.score is not None and self.score == score[0]:
            pos[0] += self.tie_pos
            neg[0] += self.tie_neg
        else:
            self.close()
        self.score, self.tie_pos, self.tie_neg = score[-1], pos[-1], neg[-1]
        pos, neg = pos[:-1], neg[:-1]
        below = np.cumsum(neg, axis=0) - neg + self.neg
        self.pairs += (pos * (2 * below + neg)).sum(0)
        self.pos += pos.sum(0)
        self.neg += neg.sum(0)


def auc_draws(df: DataFrame, key, unit: str, score: str, label: str, draws: int, seed: int, steps: list[int] | None = None, per_range: int = 4096, most: int = 512) -> DataFrame:
    """(key, draw, n_pos, n_neg, auc): AUC of every draw with ties at one half; null when a draw lacks a class.

    Rows without score (null, NaN) or label do not take part. ``unit`` rows share a weight. At most
    ``2 * most`` ranges per key and their vectors are exchanged after the rows, whatever their number; a value that
    many rows share is a range of its own, dealt to several tasks.
    """
    key, steps = list(key), steps or poisson_steps()
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    rows = rows.select(*key, F.col(score).cast("double").alias("_score"), (F.col(label) == 1).alias("_label"), *unit_hash(seed, unit))
    placed = row_ranges(rows, key, "_score", per_range, most)
    dealt = [*key, "_range", "_salt"]
    placed = placed.repartition(*dealt).sortWithinPartitions(*dealt, "_score").select(*dealt, "_score", "_label", "_h1", "_h2")
    names = ["_pos", "_neg", "_pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, now = None, None

        def closed() -> pa.RecordBatch:
            now.close()
            sums = [pa.array([v], pa.list_(pa.int64())) for v in (now.pos, now.neg, now.pairs)]
            return pa.RecordBatch.from_arrays([*open_key, *sums], [*key, "_range", *names])

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for c in dealt:
                codes = pc.dictionary_encode(b[c], null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            s, y, h1, h2 = (b[c].to_numpy(zero_copy_only=False) for c in ("_score", "_label", "_h1", "_h2"))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                row = b.slice(a, 1)
                if now is None or any(row[c][0].as_py() != v for c, v in zip(dealt, now_key, strict=True)):
                    if now is not None:
                        yield closed()
                    now_key = [row[c][0].as_py() for c in dealt]
                    open_key = [row[c] for c in dealt[:-1]]
                    now = _Range(draws, row["_range"][0].as_py() % 2 == 1)
                for lo in range(a, z, BLOCK):
                    hi = min(lo + BLOCK, z)
                    now.add(s[lo:hi], y[lo:hi], draw_weights(h1[lo:hi], h2[lo:hi], draws, steps))
        if now is not None:
            yield closed()

    schema = _ddl(placed, [*key, "_range"]) + ", ".join(f"{n} array<bigint>" for n in names)
    ranges = _summed(placed.mapInArrow(run, schema), [*key, "_range"], names, "bigint")
    before = Window.partitionBy(*key, "draw").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(F.col("_range") % 2 == 1, F.col("_pos") * F.col("_neg")).otherwise(F.col("_pairs"))
    joined = ranges.withColumn("_below", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
    total = joined.groupBy(*key, "draw").agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum(inside + 2 * F.col("_pos") * F.col("_below")).alias("_u"))
    return total.select(*key, "draw", "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / 2 / F.col("n_pos") / F.col("n_neg")).alias("auc"))


# ------------------------------------------------------------------ permutations
def round_keys(seed: int, permutation: np.ndarray) -> np.ndarray:
    """(rounds, permutations) of 32-bit keys."""
    base = mixed(np.array([seed & 0xFFFFFFFF], np.uint32)) + permutation.astype(np.uint32) * np.uint32(GOLDEN)
    return np.stack([mixed(base + np.uint32(r + 1)) for r in range(ROUNDS)])


def half_bits(n: int) -> int:
    """Bits of a half: the network works on 4 ** bits >= n positions, fewer than 4 n (or 4)."""
    return max(1, math.ceil(math.log2(max(n, 2)) / 2))


def permuted_positions(at: np.ndarray, permutation: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each position (0 .. n - 1) in its permutation; arrays of one shape or broadcastable.

    The network permutes the next power of four; places beyond n are walked on until they fall
    below it, which keeps the map a bijection on 0 .. n - 1.
    """
    bits = half_bits(n)
    at, permutation = np.broadcast_arrays(at, permutation)
    out = at.astype(np.uint64).ravel()
    keys = round_keys(seed, permutation.ravel())
    mask = np.uint32((1 << bits) - 1)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = (x >> np.uint64(bits)).astype(np.uint32), x.astype(np.uint32) & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k[walk]) & mask)
        out[walk] = left.astype(np.uint64) << np.uint64(bits) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64).reshape(at.shape)


def positions(n: str, at: str, permutation: str, seed: int) -> Column:
    """``permuted_positions`` as a column; n is one number throughout."""

    @F.pandas_udf("bigint")
    def place(a: pd.Series, p: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(permuted_positions(a.to_numpy(), p.to_numpy(), int(size.iloc[0]), seed) if len(a) else np.empty(0, np.int64))

    return place(at, permutation, n)


def permuted(df: DataFrame, subject: str, columns, permutations: int, seed: int) -> DataFrame:
    """Columns of another subject given to each subject, per permutation (0 ..); as many rows as subjects times permutations."""
    base = ordinal(df.withColumn("_hx", F.md5(F.col(subject).cast("string"))), [], "_hx", subject)
    rows = base.select(subject, "idx", "n", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    placed = rows.withColumn("_at", positions("n", "idx", "perm", seed)).select("perm", subject, "_at")
    return placed.join(base.select(F.col("idx").alias("_at"), *columns), "_at").drop("_at")


def permutation_auc(scores: DataFrame, key, subject: str, score: str, label: str, permutations: int, seed: int) -> DataFrame:
    """(key, perm, auc): AUC after each permutation of the subjects' labels, the same for every key.

    Positives take the first positions, so that a permuted label is ``place < number of positives``;
    the midranks of the scores are made once and every permutation adds up those of its positives.
    """
    key = list(key)
    people = scores.where(F.col(label).isNotNull()).groupBy(subject).agg(F.max(label).alias("_y"))
    sizes = people.agg(F.count("*").alias("_people"), F.coalesce(F.sum("_y"), F.lit(0)).alias("_ones"))
    hashed = people.withColumn("_hx", F.md5(F.col(subject).cast("string")))
    inside = ordinal(hashed, ["_y"], "_hx", subject).transform(one_row, sizes)
    place = inside.select(subject, "_people", "_ones", (F.col("idx") + F.when(F.col("_y") == 1, 0).otherwise(F.col("_ones"))).alias("_at"))
    ranked = row_midranks(scores.select(*key, subject, F.col(score).cast("double").alias(score)), key, score).select(*key, subject, (2 * F.col("midrank")).cast("bigint").alias("_rank2"))
    rows = ranked.join(place, subject).select(*key, "_rank2", "_people", "_ones", "_at")
    names = ["_ranks", "_hits", "_rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(permutations)
        for b in batches:
            if not b.num_rows:
                continue
            code, first = _key_codes(b, key)
            n, ones = b["_people"][0].as_py(), b["_ones"][0].as_py()
            at, back = np.unique(b["_at"].to_numpy(), return_inverse=True)
            sums = np.zeros((3, len(first), permutations), np.int64)
            for lo in range(0, len(at), BLOCK):
                hi = min(lo + BLOCK, len(at))
                hit = permuted_positions(at[lo:hi, None], every[None, :], n, seed) < ones
                rows_in = np.flatnonzero((back >= lo) & (back < hi))
                for c in np.unique(code[rows_in]):
                    mine = rows_in[code[rows_in] == c]
                    mine_hit = hit[back[mine] - lo]
                    sums[0, c] += np.where(mine_hit, b["_rank2"].to_numpy()[mine][:, None], 0).sum(0)
                    sums[1, c] += mine_hit.sum(0)
                    sums[2, c] += len(mine)
            keys = [b[k].take(pa.array(first)) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(list(s), pa.list_(pa.int64())) for s in sums]], [*key, *names])

    parts = rows.mapInArrow(run, _ddl(rows, key) + ", ".join(f"{n} array<bigint>" for n in names))
    g = _summed(parts, key, names, "bigint")
    pos, neg = F.col("_hits"), F.col("_rows") - F.col("_hits")
    return g.select(*key, F.col("draw").alias("perm"), F.when((pos > 0) & (neg > 0), (F.col("_ranks") - pos * (pos + 1)) / 2 / pos / neg).alias("auc"))
