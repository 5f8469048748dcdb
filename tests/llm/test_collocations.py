"""Collocations against plain counting of all windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from diurna.llm import collocations as C


def count(rows):
    out, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                out[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return out, total


def brute(rows, support, top, inside=80):
    out, total = count(rows)
    found = set()
    for lang, f in out.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cand.items():
            longer = [c for q, c in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= inside * a for c in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (s, a, _, p, k) in enumerate(sorted(kept)[:top], 1):
            found.add((lang, rank, " ".join(p), len(p), -a, k, f[p[:k]], f[p[k:]], total[lang], -s))
    return found


def made(seed=11):
    rng = random.Random(seed)
    words = ["the", "of", "THE", "a", "ä", "日本", "x-y", "end.", "q,", "z\tz", "new", "york", "\x00u"]
    rows = []
    for _ in range(120):
        text = " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40)))
        if rng.random() < 0.5:
            text += rng.choice([" in the united states of", "\nNew York city", " a a a a a", ";;", " new york"])
        rows.append((rng.choice(["en", "en", "de", None, "a\tb "]), rng.choice([text, text, None])))
    return rows + [("en", ""), ("fr", None), ("en", "new york " * 700), ("en", "same text here now"), *[("en", "same text here now")] * 9, ("xx", "once upon a time")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"tokens": 40, "entries": 30, "burst": 3}, {"tokens": 7, "entries": 1, "burst": 1}])
@pytest.mark.parametrize(("support", "top"), [(5, 2000), (3, 12)])
def test_equal_to_counting_all_windows(spark, sizes, support, top):
    rows = made()
    got = [tuple(r) for r in C.collocations(table(spark, rows), support=support, top=top, **sizes).collect()]
    want = brute(rows, support, top)
    assert len(want) > 20 and len(got) == len(want)
    assert set(got) == want


def test_trie_bursts_cuts_whole_subtrees_and_sums_them():
    rng = np.random.default_rng(2)
    w = rng.integers(1, 9, (5000, 4))
    w[rng.random(5000) < 0.2, 3] = 0
    trie = C.HatTrie(3, burst=50)
    want = Counter(map(tuple, w.tolist()))
    for part in np.array_split(w, 7):
        trie.add(part[:, 0], part[:, 1] << 2 * C.ID_BITS | part[:, 2] << C.ID_BITS | part[:, 3])
    assert trie.nodes and sum(trie.sizes().values()) == len(want)
    words = C.Words()
    list(words.ids("en", [b"w%d" % i for i in range(1, 9)]))
    sizes = trie.sizes()
    first = sorted(sizes)[:3]
    cut = trie.cut(first)
    assert sorted(trie.sizes()) == sorted(sizes)[3:] and set(cut[0].tolist()) == set(first)
    got, order = Counter(), []
    for run in C._sorted_run(words, *cut, 3):
        phrases = [g.removesuffix("\ten") for g in run["gram"].to_pylist()]
        order.append(phrases)
        for p, n in zip(phrases, run["n"].to_pylist(), strict=True):
            got[p] += n
    want3, want4 = Counter(), Counter()
    for p, n in want.items():
        if p[0] in first:
            want3[" ".join(f"w{i}" for i in p[:3])] += n
            if p[3]:
                want4[" ".join(f"w{i}" for i in p)] += n
    assert got == want3 + want4
    assert all(run == sorted(run) for run in order)


def test_bitmaps_hold_every_frequent_phrase(spark):
    words = [("en", f"w{i}") for i in range(300)] + [("de", "w1"), ("de", "é")]
    held = C.bitmap(spark.createDataFrame(words, "lang string, phrase string"), 12)
    h = np.array([C.word_hash(lang, w.encode()) for lang, w in words], np.uint64)
    assert C._holds(held, h, 12).all() and int(np.bitwise_count(held).sum()) <= len(words)
    pairs = spark.createDataFrame([("en", "w1 w2"), ("de", "é w1")], "lang string, phrase string")
    two = C.pair_hash(np.array([C.word_hash("en", b"w1"), C.word_hash("de", "é".encode())], np.uint64), np.array([C.word_hash("en", b"w2"), C.word_hash("de", b"w1")], np.uint64))
    assert C._holds(C.bitmap(pairs, 16), two, 16).all()


def test_empty_and_infrequent(spark):
    assert C.collocations(table(spark, [("en", "x")]).limit(0)).collect() == []
    assert C.collocations(table(spark, [("en", "one two three"), (None, None)])).collect() == []
