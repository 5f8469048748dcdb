"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine >= t have squared distance <= 2 - 2t. After a fixed random rotation the
coordinates are cut into blocks; if each block i is given the budget (2 - 2t) * size_i / dim,
a linked pair stays within the budget of at least one block. Each block is range-joined on its own:
a grid over its first two coordinates, with cells as wide as the block's radius, sends every vector
to its home cell and to the neighbouring cells that see it, so each pair meets once per block. Pairs
within the block's budget are candidates and are verified with the whole vectors in double
precision. A linked pair counts in the block in which it uses the smallest share of the budget (the
first of equal ones), where it always is a candidate, so no pairs are shuffled. Both sides of that
comparison are summed row by row in a fixed order: every task finds the same block.

Cells are cut into chunks of at most CHUNK home vectors; the others stream past a chunk in batches.
Equal vectors are one node with a number and a count. A task returns link counts and star edges, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.frames import pick, stored
from diurna.llm.graph import components
from diurna.llm.registry import llm_query

BLOCK, CHUNK, TILE = 8, 16384, 1024
SLACK = 1e-6  # added to block radii: float rounding must not lose a candidate


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _blocks(dim: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, dim)) for a in range(0, dim, size)]


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _turned(unit: np.ndarray, at: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated rows; unlike a matrix product's, the last bits do not depend on the other rows."""
    rows, back = np.unique(at, return_inverse=True)
    return np.einsum("ij,jk->ik", unit[rows], turn, optimize=False)[back]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest index of each component of label's graph after adding the edges (a, b)."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short


def links(vectors: DataFrame, dim: int, threshold: float, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(id, links, root): links seen for a vector in one task, weighted by copies, and a vector it is tied to."""
    blocks = _blocks(dim, block)
    budget = 2.0 - 2.0 * threshold
    limits = [budget * (b - a) / dim for a, b in blocks]
    heads, shares = np.array([a for a, _ in blocks]), np.array([b - a for a, b in blocks], float)
    turn = rotation(dim)
    kind = dict(vectors.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home row and rows for the cells that see the vector: its own and those with a smaller key."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = _unit(batch["embedding"].flatten().to_numpy(zero_copy_only=False), dim) @ turn
            for k, (a, b) in enumerate(blocks):
                width = np.sqrt(limits[k]) + SLACK
                cell = np.floor(y[:, a:min(a + 2, b)] / width).astype(np.int64)
                if cell.shape[1] == 1:
                    cell = np.column_stack([cell, np.zeros(n, np.int64)])
                for dx, dy in ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1)):
                    for home in ((True, False) if (dx, dy) == (0, 0) else (False,)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, k, np.int32)), pa.array(cell[:, 0] + dx), pa.array(cell[:, 1] + dy), pa.array(np.full(n, home)),
                             pa.array(np.full(n, (dx, dy) == (0, 0))), batch["id"], batch["copies"], batch["embedding"]],
                            ["block", "x", "y", "home", "own", "id", "copies", "embedding"])

    placed = vectors.mapInArrow(place, f"block int, x bigint, y bigint, home boolean, own boolean, id bigint, copies bigint, embedding {kind}")
    sizes = placed.where("home").groupBy("block", "x", "y").agg(F.count("*").alias("n"))
    chunks = sizes.select("block", "x", "y", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    chunks = stored(chunks, "cells")
    met = placed.join(chunks, ["block", "x", "y"])
    part = F.when(F.col("home"), F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = met.withColumn("part", F.explode(part)).drop("parts")
    dealt = dealt.repartition("block", "x", "y", "part").sortWithinPartitions("block", "x", "y", "part", F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one chunk are consecutive, its home vectors first."""
        now, homes = None, None

        def close(h: dict) -> pa.RecordBatch:
            ids, seen, root = h["ids"], h["links"], h["label"]
            on = seen > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(seen[on]), pa.array(ids[root[on]])], ["id", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "x", "y", "part")], 1)
            is_home = batch["home"].to_numpy(zero_copy_only=False)
            own = batch["own"].to_numpy(zero_copy_only=False)
            ids, copies = batch["id"].to_numpy(), batch["copies"].to_numpy()
            unit = _unit(batch["embedding"].flatten().to_numpy(zero_copy_only=False), dim)
            turned = unit @ turn
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(1) | (np.diff(is_home.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                this = tuple(key[a])
                if this != now:
                    if homes is not None and len(homes["ids"]):
                        yield close(homes)
                    now, homes = this, {"ids": np.empty(0, np.int64), "copies": np.empty(0, np.int64), "unit": np.empty((0, dim)), "turned": np.empty((0, dim)), "links": np.empty(0, np.int64), "label": np.empty(0, np.int64)}
                if is_home[a]:
                    old = len(homes["ids"])
                    homes = {"ids": np.append(homes["ids"], ids[a:b]), "copies": np.append(homes["copies"], copies[a:b]), "unit": np.concatenate([homes["unit"], unit[a:b]]), "turned": np.concatenate([homes["turned"], turned[a:b]]),
                             "links": np.append(homes["links"], np.zeros(b - a, np.int64)), "label": np.append(homes["label"], np.arange(old, old + b - a))}
                    continue
                for lo in range(a, b, TILE):
                    out = _tile(homes, ids[lo:min(b, lo + TILE)], copies[lo:min(b, lo + TILE)], unit[lo:min(b, lo + TILE)], turned[lo:min(b, lo + TILE)], own[lo:min(b, lo + TILE)], int(this[0]))
                    if out is not None:
                        yield out
        if homes is not None and len(homes["ids"]):
            yield close(homes)

    def _tile(homes: dict, ids, copies, unit, turned, own, k: int) -> pa.RecordBatch | None:
        if not len(homes["ids"]):
            return None
        a, b = blocks[k]
        rows, cols = [], []
        probe = turned[:, a:b].astype(np.float32)
        probe_sq = (probe * probe).sum(1)
        for at in range(0, len(homes["ids"]), TILE):
            base = homes["turned"][at:at + TILE, a:b].astype(np.float32)
            cross = base @ probe.T
            cross *= 2
            cross -= probe_sq
            cross -= (base * base).sum(1)[:, None]
            i, j = np.nonzero(cross >= -(limits[k] + 1e-5))
            rows.append(i + at)
            cols.append(j)
        i, j = np.concatenate(rows), np.concatenate(cols)
        keep = (homes["ids"][i] < ids[j]) | ~own[j]
        i, j = i[keep], j[keep]
        ok = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 14):
            p, q = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]
            linked = np.einsum("ij,ij->i", homes["unit"][p], unit[q]) >= threshold
            p, q, where = p[linked], q[linked], np.flatnonzero(linked) + lo
            if len(p):
                gap = (_turned(homes["unit"], p, turn) - _turned(unit, q, turn)) ** 2
                ok[where] = np.argmin(np.add.reduceat(gap, heads, axis=1) / shares, axis=1) == k
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        n = len(homes["ids"])
        np.add.at(homes["links"], i, copies[j])
        label = np.arange(n + len(ids))
        label[:n] = homes["label"]
        _merge(label, i, j + n)
        homes["label"] = label[:n].copy()
        on, inverse = np.unique(j, return_inverse=True)
        got = np.bincount(inverse, weights=homes["copies"][i].astype(np.float64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(got), pa.array(homes["ids"][label[n + on]])], ["id", "links", "root"])

    return dealt.select("block", "x", "y", "part", "home", "own", "id", "copies", "embedding").mapInArrow(compare, "id bigint, links bigint, root bigint")


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and are
    their own component. Vectors link with those of their own length; there is one join per length.
    Rows that repeat a vector link with each other, and so do rows that repeat an id with other
    vectors that are near. Rows with null ids link like others; a component without any id is null.
    An empty table gives an empty result.
    """
    rows = pick(df, vec_id=id_col, embedding=vec_col)
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = "array<float>" if rows.dtypes[1][1] == "array<float>" else "array<double>"
    rows = rows.withColumn("embedding", F.col("embedding").cast(kind)).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("dim", F.when(F.col("good"), F.size("embedding")))
    dims = sorted(r.dim for r in rows.where("good").select("dim").distinct().toLocalIterator())
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    plain = rows.where("good").withColumn("embedding", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast(kind[6:-1])))  # -0 equals 0
    distinct = plain.groupBy("embedding", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "nodes")  # numbers are fixed by writing them
    each = [links(nodes.where(F.col("dim") == d).select("id", "copies", "embedding"), d, threshold) for d in dims]
    found = stored(reduce(DataFrame.unionByName, each).groupBy("id", "root").agg(F.sum("links").alias("links")), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components")
    member = nodes.join(groups, nodes.id == groups.node, "left").withColumn("component", F.coalesce("component", "id")).join(counts, "id", "left")
    names = member.groupBy("component").agg(F.min("first").alias("component_id"))
    tied = member.join(names, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = plain.select("vec_id", "embedding").join(tied, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.9::DOUBLE),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@llm_query("op6_embedding_near_dedup", SQL)
def op6_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
