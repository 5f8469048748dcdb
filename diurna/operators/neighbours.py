"""Exact nearest neighbours as a blocked, pruned join.

Both sides are cut into blocks of at most about ``BLOCK`` rows (a crowded region is simply more
blocks), a task compares one query block with one reference block and emits only its k best per
query. When the reference is larger than one block, rows are assigned to the nearest of a few
pivots and two passes are made: the own cell gives each query an upper bound, and other cells are
visited only if the triangle inequality leaves them a chance. Few large cells and blocks keep the
copies of a row that are exchanged few: the exchange follows the rows, the comparisons stay in a task.

Inside a task one single-precision matrix product gives a lower bound of every distance (its rounding
is bounded by ``_slack``); only rows whose bound does not exceed a k-th distance already found are
measured in double precision. Nothing is dropped: pruned cells and rows provably hold no closer row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diurna.functions.hashing import hash_int
from diurna.operators.ranking import one_row
from diurna.sources.files import materialise

BLOCK = 32768
PIVOTS = 16
SCHEMA = "qid bigint, rid bigint, dist double"
GROUP, CELLS, PAIRS = 64, 1 << 22, 1 << 16  # columns of a group; bounds and measured pairs in memory at once


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    """The vectors of a column, nulls as NaN."""
    return t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)


def _finite(t: pa.Table, column: str) -> pa.Table:
    """Rows without gaps and infinities: the others are at no finite distance from any row."""
    return t.filter(pa.array(np.isfinite(_matrix(t, column)).all(axis=1))) if len(t) else t


def _slack(width: int) -> float:
    """Relative rounding of a single-precision product of that width, twice over."""
    return (width + 16) * 2.0 ** -23


def _centred(a: np.ndarray, b: np.ndarray):
    """Both sides around the mean of the reference, norms at most 1, and the unit; gaps and infinities become 0."""
    known = np.where(np.isfinite(b), b, np.nan)
    n = np.isfinite(known).sum(axis=0)
    c = np.nansum(known, axis=0) / np.maximum(n, 1)
    a, b = (np.where(np.isfinite(x), x - c, 0.0) for x in (a, b))
    unit = max(np.sqrt((x * x).sum(axis=1)).max(initial=0.0) for x in (a, b)) or 1.0
    return (a / unit, b / unit, unit) if np.isfinite(unit) else (a * 0, b * 0, 1.0)  # out of range: every bound is 0


def _padded(*parts: np.ndarray) -> np.ndarray:
    """Columns side by side as the right factor of a product; the rows become a multiple of GROUP."""
    x = np.concatenate(parts, axis=1).astype(np.float32)
    return np.concatenate([x, np.zeros((-len(x) % GROUP, x.shape[1]), np.float32)]).T.copy()


def _select(low: np.ndarray, unit: float, k: int, measure):
    """(row, column, distance): the k nearest columns of each row by distance, then column.

    ``low`` bounds squared distances from below in units of ``unit``, infinite where a column is out.
    """
    c, n = low.shape
    w = n // GROUP
    g = low.reshape(c, GROUP, w)  # a group holds the columns i, i + w, i + 2w, ...
    least = g.min(axis=1)
    kk = min(k, w)
    top = np.argpartition(least, kk - 1, axis=1)[:, :kk]
    each = np.arange(c)[:, None]
    first = g[each, :, top].argmin(axis=2) * w + top
    found = np.isfinite(low[each, first])
    far = np.full((c, kk), np.inf)
    r, j = np.nonzero(found)
    far[r, j] = measure(r, first[r, j])
    far = np.where(np.isnan(far), np.inf, far).max(axis=1) if kk == k else np.full(c, np.inf)
    with np.errstate(over="ignore"):
        bound = np.nextafter(((far / unit) ** 2 * (1 + 1e-6) + 1e-30).astype(np.float32), np.float32(np.inf))
    r, j = np.nonzero(least <= bound[:, None])
    part = g[r, :, j]
    p, i = np.nonzero((part <= bound[r, None]) & np.isfinite(part))
    rows, cols = r[p], i * w + j[p]
    dist = np.concatenate([measure(rows[s:s + PAIRS], cols[s:s + PAIRS]) for s in range(0, len(rows), PAIRS)] or [np.empty(0)])
    ok = np.isfinite(dist)
    rows, cols, dist = rows[ok], cols[ok], dist[ok]
    order = np.lexsort((cols, dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k], dist[rank < k]


def _by_id(r: pa.Table) -> pa.Table:
    return r.take(pc.sort_indices(r["rid"]))


def _best(k: int, skip_self: bool):
    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "rid": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        q, r = _finite(q, "qx"), _finite(r, "rx")
        if not len(q) or not len(r):
            return empty
        r = _by_id(r)
        a, b = _matrix(q, "qx"), _matrix(r, "rx")
        x, y, unit = _centred(a, b)
        e = _slack(a.shape[1])
        xx, yy = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
        left = np.concatenate([-2 * x, xx * (1 - e), np.ones_like(xx), -2 * e * np.sqrt(xx)], axis=1).astype(np.float32)
        right = _padded(y, np.ones_like(yy), yy * (1 - e), np.sqrt(yy))
        ids = r["rid"].drop_null().to_numpy()  # sorted; rows without an id are last
        own = q["qid"].fill_null(0).to_numpy()
        known = q["qid"].is_valid().to_numpy()
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        out = [empty]
        step = max(1, CELLS // right.shape[1])
        for s in range(0, len(a), step):
            low = left[s:s + step] @ right
            low[:, len(b):] = np.inf
            if skip_self:
                for i in np.flatnonzero((known & (lo < hi))[s:s + step]):
                    low[i, lo[s + i]:hi[s + i]] = np.inf
            rows, cols, dist = _select(low, unit, k, lambda i, j, s=s: np.sqrt(((a[s + i] - b[j]) ** 2).sum(axis=1)))
            out.append(pa.table({"qid": q["qid"].take(pa.array(rows + s)), "rid": r["rid"].take(pa.array(cols)), "dist": dist}))
        return pa.concat_tables(out)

    return compare


def _pair_blocks(q: DataFrame, r: DataFrame, keys, block: int):
    """Both sides grouped so that every query block meets every reference block of its key.

    Block numbers come from a hash of the row id and the key's size, so a block holds about
    ``block`` rows however crowded the key is. A few query blocks are made in any case, so that
    small tables are compared in more than one task.
    """
    keys = list(keys)
    spread = 4 if keys else 16

    def sizes(d, name, least):
        n = F.greatest(F.lit(1), F.ceil(F.count("*") / (block * 0.75)), F.least(F.lit(least), F.ceil(F.count("*") / 1024)))
        return F.broadcast(d.groupBy(*keys).agg(n.cast("bigint").alias(name)))  # one row per key: at most as many as pivots

    nq, nr = sizes(q, "_nq", spread), sizes(r, "_nr", 1)

    def side(d, row_id, own, other, mine, theirs):
        d = d.join(nq, keys).join(nr, keys) if keys else d.transform(one_row, nq).transform(one_row, nr)
        d = d.withColumn(own, F.pmod(hash_int("block", F.col(row_id)), F.col(mine)))
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(theirs) - 1)))
        return d.withColumn("_pair", F.concat_ws(":", *keys, "_qb", "_rb")).drop("_nq", "_nr", "_qb", "_rb", *keys).groupBy("_pair")

    return side(q, "qid", "_qb", "_rb", "_nq", "_nr").cogroup(side(r, "rid", "_rb", "_qb", "_nr", "_nq"))


def _merge(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _compare(q: DataFrame, r: DataFrame, keys, k: int, skip_self: bool, block: int) -> DataFrame:
    return _pair_blocks(q, r, keys, block).applyInArrow(_best(k, skip_self), SCHEMA)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(queries: DataFrame, reference: DataFrame, columns, k: int, query_id: str, reference_id: str,
            skip_self: bool = False, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(qid, rid, dist, rank): the k nearest reference rows of each query, ties by reference id."""
    q = queries.select(F.col(query_id).cast("bigint").alias("qid"), F.array(*[F.col(c).cast("double") for c in columns]).alias("qx"))
    r = reference.select(F.col(reference_id).cast("bigint").alias("rid"), F.array(*[F.col(c).cast("double") for c in columns]).alias("rx"))
    if r.limit(block + 1).count() <= block:  # size checked: one reference block
        return _merge(_compare(q, r, [], k, skip_self, block), k)
    # A fixed number of pivots, so the one-row array that is broadcast has a fixed size.
    whole = F.forall("rx", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # an order, not a filter: constraints on an array of many columns take the optimizer very long
    piv = r.orderBy(~whole, hash_int("pivot", F.col("rid")), "rid").limit(pivots).agg(F.sort_array(F.collect_list(F.struct("rid", "rx"))).alias("_p"))
    gaps = lambda x: F.transform("_p", lambda z: _distance(z["rx"], F.col(x)))
    rc = r.transform(one_row, piv).withColumn("_d", gaps("rx")).withColumns({
        "cell": (F.array_position("_d", F.array_min("_d")) - 1).cast("int"), "_r": F.array_min("_d")}).drop("_p", "_d")
    rc = materialise(rc, "cells")  # read by both passes; the pivots' distances are worked out once
    qc = q.transform(one_row, piv).withColumn("_d", gaps("qx")).drop("_p")
    own = materialise(qc.withColumn("cell", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")), "cells")
    ref = rc.select("rid", "rx", "cell")
    first = materialise(_merge(_compare(own.select("qid", "qx", "cell"), ref, ["cell"], k, skip_self, block), k), "own_cell")
    bound = first.where(F.col("rank") == k).select("qid", F.col("dist").alias("_bound"))
    radius = rc.where(F.col("_r") < float("inf")).groupBy("cell").agg(F.max("_r").alias("_radius"))  # at most ``pivots`` rows; NaN is above infinity
    radii = radius.agg(F.map_from_entries(F.collect_list(F.struct("cell", "_radius"))).alias("_radii"))
    # Cells that may still hold a closer row, decided inside the row: nothing is exploded in vain.
    reach = F.coalesce(F.col("_bound") * (1 + 1e-9) + 1e-12, F.lit(float("inf")))
    open_cells = F.filter(
        F.transform("_d", lambda g, i: F.struct(i.alias("cell"), g.alias("gap"))),
        lambda z: (z["cell"] != F.col("cell")) & (z["gap"] - F.try_element_at("_radii", z["cell"]) <= reach))
    others = own.join(bound, "qid", "left").transform(one_row, radii).select("qid", "qx", F.explode(open_cells).alias("_z")).select(
        "qid", "qx", F.col("_z.cell").alias("cell"))
    second = _compare(others.select("qid", "qx", "cell"), ref, ["cell"], k, skip_self, block)
    return _merge(first.select("qid", "rid", "dist").unionByName(second), k)


IMPUTE_SCHEMA = "qid bigint, feature int, rid bigint, dist double, value double"


def _donors(k: int):
    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "feature": pa.array([], pa.int32()), "rid": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "value": pa.array([], pa.float64())})
        if not len(q) or not len(r):
            return empty
        r = _by_id(r)
        a, b = _matrix(q, "qx"), _matrix(r, "rx")
        width = a.shape[1]
        x, y, unit = _centred(a, b)
        ma, mb = (~np.isnan(a)).astype(np.float32), (~np.isnan(b)).astype(np.float32)
        e = _slack(3 * width)
        xx, yy = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
        left = np.concatenate([x * x, ma, -2 * x, -e * xx, -e * np.ones_like(xx), -2 * e * np.sqrt(xx)], axis=1).astype(np.float32)
        right = _padded(mb, y * y, y, np.ones_like(yy), yy, np.sqrt(yy))
        has = _padded(mb)
        out = [empty]

        def measure(i, j):
            u, v = a[i], b[j]
            both = ~np.isnan(u) & ~np.isnan(v)
            n = both.sum(axis=1)
            return np.where(n > 0, np.sqrt(np.where(both, (v - u) ** 2, 0.0).sum(axis=1) * width / np.maximum(n, 1)), np.inf)

        step = max(1, CELLS // right.shape[1])
        gaps, features = np.nonzero(np.isnan(a))  # the cells to fill
        for s in range(0, len(gaps), step):
            at, f = gaps[s:s + step], features[s:s + step]
            rows, back = np.unique(at, return_inverse=True)
            n = ma[rows] @ has
            with np.errstate(divide="ignore", invalid="ignore"):
                low = np.where(n > 0, np.maximum(left[rows] @ right, 0) * np.float32(width * (1 - 1e-6)) / n, np.float32(np.inf))
            low = np.where(has[f] > 0, low[back], np.float32(np.inf))
            i, j, dist = _select(low, unit, k, lambda i, j, at=at: measure(at[i], j))
            out.append(pa.table({"qid": q["qid"].take(pa.array(at[i])), "feature": f[i].astype(np.int32), "rid": r["rid"].take(pa.array(j)), "dist": dist, "value": b[j, f[i]]}))
        return pa.concat_tables(out)

    return compare


def knn_impute(df: DataFrame, train: DataFrame, columns, row_id: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """Missing cells become the mean of the k nearest train rows that have the cell.

    Distance skips missing coordinates and rescales by their number; it is not a metric, so
    no cell can be pruned and every query block meets every reference block.
    """
    def arr(d, n, x):
        return d.select(F.col(row_id).cast("bigint").alias(n), F.array(*[F.col(c).cast("double") for c in columns]).alias(x))

    q = arr(df, "qid", "qx").where(F.exists("qx", lambda x: x.isNull()))
    r = arr(train, "rid", "rx")
    parts = _pair_blocks(q, r, [], block).applyInArrow(_donors(k), IMPUTE_SCHEMA)
    w = Window.partitionBy("qid", "feature").orderBy("dist", "rid")
    means = parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("qid", "feature").agg(F.avg("value").alias("v"))
    wide = means.groupBy("qid").agg(*[F.max(F.when(F.col("feature") == i, F.col("v"))).alias(f"_f{i}") for i in range(len(columns))])
    j = df.join(wide, F.col(row_id) == F.col("qid"), "left")
    keep = [F.coalesce(F.col(c), F.col(f"_f{columns.index(c)}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return j.select(*keep)
