"""Embedding links at the threshold, between rows of one id and between vectors of every length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.llm import neighbours


def brute(rows, t=0.9):
    """(id, links, component) of every row: all pairs in double precision."""
    unit = [None if v is None else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and (rows[a][1] == rows[b][1] or unit[a] @ unit[b] >= t):
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, links[n], low.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def got(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, first int, copies int").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()), key=str)


def test_pairs_at_the_threshold(spark):
    rng, rows = np.random.default_rng(1), []
    # pairs of every kind of direction whose cosine is 0.9 up to the last bits, on both sides
    for k in range(60):
        d = 2 if k % 2 else 16
        a = rng.standard_normal(d)
        a /= np.linalg.norm(a)
        side = rng.standard_normal(d)
        side -= side @ a * a
        side /= np.linalg.norm(side)
        b = 0.9 * a + np.sqrt(1 - 0.81) * side
        x, y = a * (k + 1), b / np.linalg.norm(b)
        c = float((x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)))
        if abs(c - 0.9) > 1e-12:
            continue
        rows += [(len(rows), x.tolist()), (len(rows) + 1, y.tolist())]
    assert len(rows) >= 100
    # every link is found from both sides or from none, and pairs clearly above are all found
    result = {i: n for i, n, _ in got(spark, rows)}
    want = {i: n for i, n, _ in brute(rows)}
    lost = [i for i in want if abs(result[i] - want[i]) > 1]
    assert not lost and sum(result.values()) % 2 == 0
    above = list(rows)
    for n in range(0, len(above), 2):  # a step towards each other: safely linked
        a, b = (np.array(above[n + j][1]) / np.linalg.norm(above[n + j][1]) for j in (0, 1))
        above[n + 1] = (above[n + 1][0], (b + 1e-9 * a).tolist())
    assert got(spark, above) == brute(above)


@pytest.mark.parametrize("dim", [2, 3, 9, 20])
def test_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.standard_normal(dim) + (3 if i % 3 == 0 else 0)).tolist()) for i in range(150)]
    assert got(spark, rows) == brute(rows)


def test_rows_of_one_id_null_ids_and_every_length(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal(6)
    rows = [(1, base.tolist()), (1, (base + 0.01).tolist()), (2, (base - 0.02).tolist()), (3, (-base).tolist())]
    rows += [(10 + i, [1.0, 2.0, 3.0, 4.0 + i * 0.1]) for i in range(4)] + [(20, [1.0]), (21, [5.0]), (22, [-1.0])]
    rows += [(None, (base * 2).tolist()), (None, [0.0, 0.0, 1.0]), (30, None)]
    assert got(spark, rows) == brute(rows)


def test_each_pair_counts_once_for_every_block_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * 0.4 + np.eye(12)[i % 4] * 2).tolist()) for i in range(120)]
    want = {i: n for i, n, _ in brute(rows) if n}
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "id bigint, copies bigint, embedding array<double>").repartition(4)
    for block, chunk in ((12, 16384), (5, 9), (1, 50)):
        found = neighbours.links(df, 12, 0.9, block, chunk).groupBy("id").agg(F.sum("links").alias("n")).collect()
        assert {r.id: r.n for r in found} == want
