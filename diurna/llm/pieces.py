"""Piece lattices of many distinct pre-tokens at once, on UTF-8 bytes.

The vocabulary is a SentencePiece model with byte fallback. A space stands for its word mark, a
space is put before the text, and a mark inside the text is spelled in bytes, so decoding is
lossless. No piece has a space after another byte, so the lattice of a text falls apart exactly at
each space that follows another byte; it also does around bytes that no piece contains.
The parts are the pre-tokens: the lattice of a text is the chain of theirs.

The model's scores are merge ranks, not probabilities. Pieces get Zipf weights by rank instead,
log(1 / (rank + 3)); a fallback byte gets the weight of a rank ten times the vocabulary's size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from diurna.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    content: list[bytes]
    logs: np.ndarray
    byte_ids: np.ndarray
    suffixes: np.ndarray  # sorted hashes of all suffixes of pieces
    suffix_piece: np.ndarray  # the piece that this suffix is, or -1
    chars: np.ndarray  # sorted hashes of one-character pieces
    alone: np.ndarray  # by byte: an ASCII byte in no piece
    starts: np.ndarray
    data: np.ndarray


def _hash(b: bytes) -> np.uint64:
    values = _TABLE[np.frombuffer(b, np.uint8)]
    return W.spans(values, np.array([0]), np.array([len(b)]))[0]


_TABLE = W.byte_values()


@functools.cache
def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    content, byte_ids, normal = [], np.full(256, -1), []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            content.append(bytes([int(piece[1:-1], 16)]))
            byte_ids[content[-1][0]] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            content.append(b"")
        else:
            content.append(piece.replace("▁", " ").encode())
            normal.append(i)
    if (byte_ids < 0).any() or any(b" " in content[i].lstrip(b" ") for i in normal):
        raise ValueError("the model needs byte fallback and pieces with spaces in front only")
    rank = np.empty(n)
    rank[sorted(normal, key=lambda i: (-sp.get_score(i), i))] = np.arange(len(normal))
    logs = np.full(n, -np.log(10.0 * n))
    logs[normal] = -np.log(rank[normal] + 3)
    suffixes = {content[i][k:]: -1 for i in normal for k in range(len(content[i]))}
    for i in normal:
        suffixes[content[i]] = i
    keys = np.array([_hash(s) for s in suffixes], np.uint64)
    order = np.argsort(keys)
    chars = np.sort(np.array([_hash(content[i]) for i in normal if len(content[i].decode()) == 1], np.uint64))
    used = set(b"".join(content[i] for i in normal))
    alone = np.array([b < 128 and b not in used for b in range(256)])
    lengths = np.array([len(c) for c in content])
    return Vocabulary(content, logs, byte_ids, keys[order], np.array(list(suffixes.values()))[order], chars, alone,
                      np.concatenate([[0], np.cumsum(lengths)]), np.frombuffer(b"".join(content), np.uint8))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Texts:
    """Rows lo..hi with a space before each: bytes, row limits, pre-token limits and hashes, pre-tokens per row."""

    lo: int
    hi: int
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    offsets: np.ndarray


def pretokens(column: pa.Array, v: Vocabulary) -> Iterator[Texts]:
    data, offsets = W.buffers(column)
    for lo, hi in W.row_ranges(offsets):
        part = data[offsets[lo]: offsets[hi]]
        rows = offsets[lo: hi + 1] - offsets[lo]
        empty = np.diff(rows) == 0
        marked = np.insert(part, rows[:-1][~empty], np.uint8(32))  # no mark before an empty text
        rows = rows + np.concatenate([[0], np.cumsum(~empty)])
        space, alone = marked == 32, v.alone[marked]
        cut = np.zeros(len(marked) + 1, bool)
        cut[rows] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        cut[1:] |= alone
        cut[:-1] |= alone
        limits = np.flatnonzero(cut)
        starts, ends = limits[:-1], limits[1:]
        yield Texts(lo, hi, marked, rows, starts, ends, W.hashed(marked, starts, ends), np.searchsorted(starts, rows))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[start:end] one after the other, and their limits."""
    lengths = ends - starts
    limits = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(limits[-1]) + np.repeat(starts - limits[:-1], lengths)
    return data[at], limits


def arcs(data: np.ndarray, first: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``ends``, start byte, piece) of every piece that ends at byte ``ends[i]`` and starts at or after ``first[i]``.

    Extends to the left one byte at a time while what is covered is a suffix of some piece.
    """
    power, inverse = W._powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    tail = np.append(lead[1:], len(data))
    own = W.mix((total[tail] - total[lead]) * inverse[lead] + (tail - lead).astype(np.uint64))
    _, known = _find(v.chars, own)
    spelled = np.repeat(~known, tail - lead)
    who = np.flatnonzero(spelled[ends - 1])
    out = [(who, ends[who] - 1, v.byte_ids[data[ends[who] - 1]])]
    active, length = np.arange(len(ends)), 1
    while True:
        active = active[ends[active] - length >= first[active]]
        if not len(active):
            break
        end = ends[active]
        start = end - length
        at, found = _find(v.suffixes, W.mix((total[end] - total[start]) * inverse[start] + np.uint64(length)))
        active, start, piece = active[found], start[found], v.suffix_piece[at[found]]
        whole = piece >= 0
        out.append((active[whole], start[whole], piece[whole]))
        length += 1
    who, start, piece = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((start, who))
    return who[order], start[order], piece[order]
