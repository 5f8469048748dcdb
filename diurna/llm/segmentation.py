"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

For each distinct pre-token, forward sums give the total weight of all segmentations of each
prefix, and with them the odds of the last piece at every position. Each occurrence is then
sampled from its end to its start. The random numbers are hashes of (row key, place of the
pre-token in the text, step), so a row's segmentation depends on its key and text only: not on
partitions, batches or retries. Lattices are kept for a bounded number of distinct pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm import words as W
from diurna.llm.frames import documents, in_batches, pick
from diurna.llm.pieces import MODEL, Texts, Vocabulary, arcs, gather, load, pretokens
from diurna.llm.registry import llm_query

KEEP = 100_000  # distinct pre-tokens whose lattices a task holds at a time
SEED = 7


class Lattices:
    """Odds of the last piece at every position of the pre-tokens seen so far."""

    def __init__(self, v: Vocabulary, alpha: float):
        self.v, self.alpha = v, alpha
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # sorted
        self.node = np.empty(0, np.int64)  # first node of the pre-token
        self.nodes = self.arcs = 0
        self.first = np.empty(0, np.int64)  # of a node, its first arc
        self.limit = np.empty(0, np.uint32)  # of an arc, the upper bound of its share; the last one's is the largest number
        self.back = np.empty(0, np.min_scalar_type(int(np.diff(self.v.starts).max(initial=1))))  # bytes from its end to its start
        self.piece = np.empty(0, np.min_scalar_type(len(self.v.content)))

    def _grow(self, name: str, used: int, new: np.ndarray) -> None:
        """Append to an array that doubles when it is full, so that it is not copied for every batch."""
        held = getattr(self, name)
        if used + len(new) > len(held):
            held = np.concatenate([held[:used], np.empty(used + 2 * len(new), held.dtype)])
            setattr(self, name, held)
        held[used:used + len(new)] = new

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Pre-tokens not seen before, by rising key; each position of their bytes, and the place before them, is a node."""
        flat, limits = gather(data, starts, ends)
        size = np.diff(limits)
        base = limits[:-1] + np.arange(len(size))  # a pre-token of n bytes has n + 1 nodes
        token = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(flat)) - limits[:-1][token] + 1
        who, start, piece = arcs(flat, limits[:-1][token], np.arange(1, len(flat) + 1), self.v)
        tok = token[who]
        end_node = base[tok] + place[who]
        start_node = base[tok] + start - limits[:-1][tok]
        logs = self.v.logs[piece] * self.alpha
        forward = np.full(len(flat) + len(size), -np.inf)
        forward[base] = 0.0
        bound = np.empty(len(who), np.int64)
        order = np.argsort(place[who], kind="stable")
        steps = np.searchsorted(place[who][order], np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            if a == b:
                continue
            e = order[a:b]
            value = forward[start_node[e]] + logs[e]
            cut = np.flatnonzero(np.diff(end_node[e], prepend=-1))
            top = np.maximum.reduceat(value, cut)
            many = np.diff(np.append(cut, len(e)))
            weight = np.exp(value - np.repeat(top, many))
            total = np.add.reduceat(weight, cut)
            forward[end_node[e[cut]]] = top + np.log(total)
            units = (weight / np.repeat(total, many) * (1 << 32)).astype(np.int64)  # whole units: sums don't depend on neighbours
            upto = np.cumsum(units)
            bound[e] = upto - np.repeat(upto[cut] - units[cut], many)
        last = np.flatnonzero(np.diff(end_node, append=-1))
        bound = np.minimum(bound, (1 << 32) - 1)
        bound[last] = (1 << 32) - 1
        self._grow("first", self.nodes, np.searchsorted(end_node, np.arange(len(flat) + len(size))) + self.arcs)
        self._grow("limit", self.arcs, bound.astype(np.uint32))
        self._grow("back", self.arcs, end_node - start_node)
        self._grow("piece", self.arcs, piece)
        self.arcs += len(end_node)
        at = np.searchsorted(self.keys, keys)  # the new keys are sorted, too
        self.keys, self.node = np.insert(self.keys, at, keys), np.insert(self.node, at, base + self.nodes)
        self.nodes += len(flat) + len(size)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.node[np.searchsorted(self.keys, keys)]

    def sample(self, node: np.ndarray, length: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all occurrences in order, number of pieces of each)."""
        now = node + length
        who, taken = np.arange(len(node)), []
        count = np.zeros(len(node), np.int64)
        step = 0
        while len(who):
            r = np.minimum(W.mix(seeds[who] + np.uint64(step)) >> np.uint64(32), np.uint64((1 << 32) - 2)).astype(np.uint32)
            arc = self.first[now[who]]
            on = np.flatnonzero(self.limit[arc] <= r)
            while len(on):  # to the first arc whose bound is above the number
                arc[on] += 1
                on = on[self.limit[arc[on]] <= r[on]]
            taken.append((who, self.piece[arc]))
            now[who] -= self.back[arc]
            count[who] += 1
            who = who[now[who] > node[who]]
            step += 1
        total = np.cumsum(count)
        out = np.empty(int(total[-1]) if len(total) else 0, np.int32)
        for k, (w, piece) in enumerate(taken):
            out[total[w] - 1 - k] = piece
        return out, count


def segment(t: Texts, held: Lattices, row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the rows one after the other, their limits by row, and whether each row's pieces are its bytes."""
    v, alpha = held.v, held.alpha
    width = np.diff(v.starts)
    unique, at, back = np.unique(t.keys, return_index=True, return_inverse=True)
    if len(held.keys) + len(unique) > KEEP:
        held.clear()
    fresh = at[~np.isin(unique, held.keys, assume_unique=True)]
    if len(fresh):
        held.add(t.data, t.starts[fresh], t.ends[fresh], t.keys[fresh])
    per_row = np.diff(t.offsets)
    row = np.repeat(np.arange(t.hi - t.lo), per_row)
    place = np.arange(len(row)) - t.offsets[:-1][row]
    seeds = W.mix(row_keys[row] + W.mix(place.astype(np.uint64)))
    pieces, count = held.sample(held.find(unique)[back], t.ends - t.starts, seeds)
    upto = np.concatenate([[0], np.cumsum(count)])[t.offsets]
    made, _ = gather(v.data, v.starts[pieces], v.starts[pieces] + width[pieces])
    limits = np.concatenate([[0], np.cumsum(width[pieces])])[upto]
    good = np.ones(t.hi - t.lo, bool)
    if not np.array_equal(limits, t.rows) or not np.array_equal(made, t.data):
        good[:] = [np.array_equal(made[a:z], t.data[c:d]) for a, z, c, d in zip(limits[:-1], limits[1:], t.rows[:-1], t.rows[1:], strict=True)]
    if not good.all():  # two pre-tokens share a hash: these rows get lattices of their own, found by place
        lists = np.split(pieces, upto[1:-1])
        for i in np.flatnonzero(~good):
            a, z = t.offsets[i], t.offsets[i + 1]
            alone, own = Lattices(v, alpha), np.arange(z - a, dtype=np.uint64)
            alone.add(t.data, t.starts[a:z], t.ends[a:z], own)
            lists[i], _ = alone.sample(alone.find(own), t.ends[a:z] - t.starts[a:z], seeds[a:z])
            good[i] = b"".join(v.content[p] for p in lists[i]) == t.data[t.rows[i]:t.rows[i + 1]].tobytes()
        upto = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        pieces = np.concatenate(lists)
    return pieces, upto, good


def encode(df: DataFrame, id_col="doc_id", text_col="text", model: str = MODEL, seed: int = SEED, alpha: float = 1.0, key_cols=None) -> DataFrame:
    """One row per input row: doc_id, pieces (array of ids), lossless (decoding the ids gave the text's bytes).

    Segmentations are drawn with odds proportional to the product of piece weights to the power
    ``alpha``. Null text gives null pieces and lossless null; empty text gives no pieces. Rows equal
    in key (``key_cols``, else the id; null is a key like others) and text get equal pieces. An
    empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col, **{f"k{i}": c for i, c in enumerate(key_cols or [id_col])})
    key = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"k{i}").cast("string"), F.lit("\0null")) for i in range(len(key_cols or [id_col]))])
    kind = rows.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        held = Lattices(v, alpha)
        for b in batches:
            row_keys = b["key"].to_numpy().view(np.uint64)
            for t in pretokens(b["text"], v):
                pieces, upto, good = segment(t, held, row_keys[t.lo:t.hi])
                part = b.slice(t.lo, t.hi - t.lo)
                null = part["text"].is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(pieces), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists, pa.array(good, mask=null)], ["doc_id", "pieces", "lossless"])

    return in_batches(rows.select("doc_id", "text", key.alias("key")), run, f"doc_id {kind}, pieces array<int>, lossless boolean")


def decode(df: DataFrame, id_col="doc_id", pieces_col="pieces", model: str = MODEL) -> DataFrame:
    """doc_id, text: the pieces' bytes without the first space. Null pieces give null text; ids outside the model are an error."""
    rows = pick(df, doc_id=id_col, pieces=pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = load(model).content
        for b in batches:
            texts = [None if p is None else b"".join(content[i] for i in p)[1:].decode() for p in b["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, text string")


@llm_query("op7_sentencepiece")
def op7_sentencepiece(spark, sf_dir):
    out = encode(documents(spark, sf_dir))
    return out.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "lossless")
