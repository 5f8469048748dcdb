"""Hashes of words: no systematic collisions, and what depends on them."""

import numpy as np
import pyarrow as pa
import pytest

from diurna.llm import jaccard, segmentation, substrings, tokencounts
from diurna.llm import words as W
from diurna.llm.pieces import load, pretokens


def pattern(n, swap):
    """The sequence in which a letter is the parity of its place's bits: it collides with its complement in polynomials modulo 2^64."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


PAIR = [pattern(1 << 12, 0), pattern(1 << 12, 1)]


def hashes(texts, **k):
    return np.concatenate([c.words for c in W.chunks(pa.array(texts), **k)])


def test_two_letter_patterns_do_not_collide():
    words = [pattern(1 << k, s) for k in range(4, 13) for s in (0, 1)]
    assert len(set(hashes(words).tolist())) == len(words)
    assert len(set(hashes(words, seed=99).tolist())) == len(words)


def test_a_hash_depends_on_the_bytes_only():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcé日"), rng.integers(1, 40))) for _ in range(3000)]
    flat = hashes([" ".join(words)])
    assert (flat == hashes(words)).all() and (flat == hashes(["  \n".join(words[i:i + 7]) for i in range(0, 3000, 7)])).all()
    assert len(set(flat.tolist())) == len(set(words))
    assert (hashes(["ABC é É"], fold=True) == hashes(["abc é É"])).all()
    assert hashes(["a\x00", "a"]).tolist()[0] != hashes(["a"]).tolist()[0]


@pytest.fixture(scope="module")
def docs(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    return spark.createDataFrame([(i, f"{w} {tail}") for i, w in enumerate(PAIR)], "doc_id bigint, text string")


def test_no_word_is_removed_from_texts_that_share_no_window(docs):
    got = substrings.repeats(docs).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_no_link_of_texts_that_share_too_little(spark):
    d = spark.createDataFrame([(i, " ".join([w] * 9)) for i, w in enumerate(PAIR)], "doc_id bigint, text string")
    assert {r.component_id for r in jaccard.near_duplicates(d).collect()} == {0, 1}


def test_pieces_are_lossless(docs):
    got = {r.doc_id: r for r in segmentation.encode(docs).collect()}
    assert all(r.lossless for r in got.values()) and got[0].pieces != got[1].pieces


def test_rows_of_colliding_pretokens_get_their_own_lattices():
    v = load()
    column = pa.array(["alpha beta gamma", "delta beta zeta", "alpha", "", None])
    keys = np.arange(5, dtype=np.uint64)
    for t in pretokens(column, v):
        want = segmentation.segment(t, segmentation.Lattices(v, 1.0), keys)
        t.keys = (t.ends - t.starts).astype(np.uint64)  # pre-tokens of one length clash
        got = segmentation.segment(t, segmentation.Lattices(v, 1.0), keys)
        assert got[2].all() and all((a == b).all() for a, b in zip(got, want, strict=True))


def test_counts_of_both_words(docs):
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(docs).collect()}
    alone = [tokencounts.token_counts(docs.where(f"doc_id = {i}")).first().n_tokens for i in (0, 1)]
    assert [got[0], got[1]] == alone


def test_trie_nodes_are_prefixes():
    words = [b"abc", b"abd", b"ab", b"x", b"", b"abc", b"xyz" * 50]
    flat = np.frombuffer(b"".join(words), np.uint8)
    limits = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    spot, node = tokencounts.trie(flat, limits)
    prefix = [w[:k + 1] for w in words for k in range(len(w))]
    assert len(spot) == len(set(prefix)) == node.max()
    assert len({(n, p) for n, p in zip(node.tolist(), prefix, strict=True)}) == len(spot)
    assert (node[spot] == np.arange(1, len(spot) + 1)).all()
