"""Token counts under a unigram piece model, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens of a batch share a trie: a node is a distinct prefix. The best score of a node
is the maximum over pieces that end there of the score of the ancestor before the piece plus the
piece's weight, computed once per node and level by level; the number of pieces on the best path goes
along. Counts at the terminal nodes are kept for a bounded number of pre-tokens and added up per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from diurna.llm.frames import documents, pick
from diurna.llm.pieces import MODEL, Vocabulary, arcs, gather, load, pretokens
from diurna.llm.registry import llm_query

KEEP = 500_000


def trie(flat: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which each node was first seen, node of each byte): nodes are numbered from 1 by depth, 0 is the root.

    A node is its parent and a byte, so equal prefixes, and only these, share one.
    """
    size = np.diff(limits)
    longest = np.argsort(-size, kind="stable")
    first, above = limits[:-1][longest], np.zeros(len(size), np.int64)
    node, spots, made = np.empty(len(flat), np.int64), [np.empty(0, np.int64)], 1
    reach = np.searchsorted(-size[longest], -np.arange(1, int(size.max(initial=0)) + 1), side="right")  # pre-tokens of at least that length
    for depth, n in enumerate(reach.tolist()):
        at = first[:n] + depth
        _, spot, child = np.unique(above[:n] << 8 | flat[at], return_index=True, return_inverse=True)
        above = child + made
        node[at] = above
        spots.append(at[spot])
        made += len(spot)
    return np.concatenate(spots), node


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Pieces of the best segmentation of each pre-token; of equal scores the one with fewer pieces."""
    flat, limits = gather(data, starts, ends)
    size = np.diff(limits)
    token = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - limits[:-1][token] + 1
    here = np.arange(1, len(flat) + 1)
    spot, node = trie(flat, limits)
    depth = place[spot]
    who, start, piece = arcs(flat, limits[:-1][token[spot]], here[spot], v)
    first = limits[:-1][token[spot[who]]]
    before = np.where(start == first, 0, node[np.maximum(start - 1, 0)])
    best = np.full(len(spot) + 1, -np.inf)
    count = np.zeros(len(spot) + 1, np.int64)
    best[0] = 0.0
    level = depth[who]
    order = np.argsort(level, kind="stable")
    steps = np.searchsorted(level[order], np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        if a == b:
            continue
        e = order[a:b]
        score = best[before[e]] + v.logs[piece[e]]
        cut = np.flatnonzero(np.diff(who[e], prepend=-1))
        top = np.maximum.reduceat(score, cut)
        many = np.diff(np.append(cut, len(e)))
        tokens = np.where(score == np.repeat(top, many), count[before[e]] + 1, np.iinfo(np.int64).max)
        best[who[e[cut]] + 1] = top
        count[who[e[cut]] + 1] = np.minimum.reduceat(tokens, cut)
    return count[node[limits[1:] - 1]]


def token_counts(df: DataFrame, id_col="doc_id", text_col="text", model: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens, n_bytes. Null and empty texts count 0. An empty table gives an empty result."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            for t in pretokens(b["text"], v):
                unique, at, back = np.unique(t.keys, return_index=True, return_inverse=True)
                if len(keys) + len(unique) > KEEP:
                    keys, counts = keys[:0], counts[:0]
                fresh = at[~np.isin(unique, keys, assume_unique=True)]
                if len(fresh):
                    keys = np.concatenate([keys, t.keys[fresh]])
                    counts = np.concatenate([counts, trie_counts(t.data, t.starts[fresh], t.ends[fresh], v)])
                    order = np.argsort(keys)
                    keys, counts = keys[order], counts[order]
                each = counts[np.searchsorted(keys, unique)][back] if len(unique) else np.empty(0, np.int64)
                tokens = np.diff(np.concatenate([[0], np.cumsum(each)])[t.offsets])
                part = b.slice(t.lo, t.hi - t.lo)
                marks = (np.diff(t.rows) > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(tokens), pa.array(np.diff(t.offsets)), pa.array(np.diff(t.rows) - marks)],
                    ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_tokens bigint, n_pretokens bigint, n_bytes bigint")


@llm_query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
