"""Divergence audit against sums over all terms with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from diurna.llm import divergence as D


def brute(rows, least=3, top=200):
    words, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        words[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in {g for g, _ in words}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        groups = {s: {t: words[lang, s][t] for t in kept} for g, s in words if g == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            above = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", above, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def made(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ä", "b", "日", "z") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de", None])
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60))
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", "!1_2", "\x00É-é"])
        rows.append((lang, rng.choice(["s1", "s2", "s3", None, ""]), rng.choice([text, text, text, None, ""])))
    rows += [rows[0]] * 5 + [("fr", "s1", "one two"), ("fr", "s2", ""), ("fr", None, None), ("es", "only", "uno uno dos " * 3)] + [("en", "s9", None), ("en", "s1", "long " * 50_000)]
    return rows


def table(spark, rows):
    clash = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(clash, "lang string, source string, text string, term string, n int").repartition(5)


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 7, "dense_from": 2, "held": 40}, {"block_terms": 64, "dense_from": 1}])
def test_equal_to_sums_over_all_terms(spark, sizes):
    rows = made()
    got = [tuple(r) for r in D.audit(table(spark, rows), **sizes).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_top_and_ties(spark):
    rows = [("en", s, t) for s, t in (("a", "x y z w"), ("a", "x y z w"), ("b", "w q"), ("b", "w q"))]
    got = {tuple(r) for r in D.audit(table(spark, rows), least=2, top=2).collect()}
    assert got == brute(rows, 2, 2)
    assert [i for *_, part, i, _, rank in sorted(got, key=lambda r: r[5]) if part == "term" and rank <= 2][:2]


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 4 * 10**12, 9 * 10**17, 10**9 + 7
    got = spark.range(1).select(D.share(F.lit(n).cast("bigint"), F.lit(total).cast("bigint"), F.lit(terms).cast("bigint")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + terms)


def test_empty_table(spark):
    assert D.audit(table(spark, []).limit(0)).collect() == []
