"""Column expressions over one array per row.

A row is one bounded recording (a day of at most 1440 minutes, or one value per
calendar day of a subject), so every function here is a narrow projection: no
shuffle, no explode.  Missing positions are NULL elements.

``let`` evaluates an expression once and hands it to the body; without it an
outer expression used in a lambda would be evaluated for each element.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def known(a: Column) -> Column:
    return F.array_compact(a)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def mean(a: Column) -> Column:
    """Mean of the non-missing elements."""
    return let(known(a), lambda v: F.try_divide(total(v), F.size(v)))


def is_code(k):
    """Predicate x == k. A keyword default in a lambda would be read as a second lambda argument."""
    return lambda x: x == k


def share(a: Column, predicate) -> Column:
    """Share of non-missing elements for which the predicate holds."""
    return let(known(a), lambda v: F.try_divide(F.size(F.filter(v, predicate)).cast("double"), F.size(v)))


def count_if(a: Column, predicate) -> Column:
    return F.size(F.filter(a, predicate))


def centred_power(v: Column, p: int) -> Column:
    """Sum of (x - mean)^p over an array without missing elements."""
    return let(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(x - m, F.lit(float(p)))))


def sd(a: Column, ddof: int = 0) -> Column:
    return F.sqrt(var(a, ddof))


def var(a: Column, ddof: int = 0) -> Column:
    return let(
        known(a),
        lambda v: F.when(F.size(v) > ddof, centred_power(v, 2) / (F.size(v) - ddof)),
    )


def skewness(a: Column, min_n: int = 3) -> Column:
    """Population skewness; NULL when the spread is zero."""
    return let(known(a), lambda v: let(sd(v), lambda s: F.when(
        (F.size(v) >= min_n) & (s > 1e-12), centred_power(v, 3) / F.size(v) / F.pow(s, F.lit(3.0)))))


def kurtosis(a: Column, min_n: int = 3) -> Column:
    """Population excess kurtosis; NULL when the spread is zero."""
    return let(known(a), lambda v: let(sd(v), lambda s: F.when(
        (F.size(v) >= min_n) & (s > 1e-12), centred_power(v, 4) / F.size(v) / F.pow(s, F.lit(4.0)) - 3)))


def skewness_unbiased(a: Column) -> Column:
    return let(F.size(known(a)), lambda n: F.when(
        n > 2, skewness(a) * F.sqrt(n * (n - 1.0)) / (n - 2)))


def kurtosis_unbiased(a: Column) -> Column:
    return let(F.size(known(a)), lambda n: F.when(
        n > 3, ((n + 1) * kurtosis(a) + 6) * (n - 1.0) / ((n - 2) * (n - 3))))


def ordered(a: Column) -> Column:
    return F.sort_array(known(a))


def quantile(sorted_a: Column, q: float) -> Column:
    """Linear-interpolated quantile of an array already sorted by ``ordered``."""
    return let(sorted_a, lambda v: let((F.size(v) - 1) * F.lit(float(q)), lambda h: let(
        F.floor(h).cast("int"),
        lambda lo: F.get(v, lo) + (F.get(v, F.least(lo + 1, F.size(v) - 1)) - F.get(v, lo)) * (h - lo))))


def median(a: Column) -> Column:
    return let(ordered(a), lambda v: F.when(F.size(v) > 0, quantile(v, 0.5)))


def trimmed_mean(a: Column, cut: float = 0.1) -> Column:
    """Mean after removing floor(cut * n) elements from each end."""
    return let(ordered(a), lambda v: let(
        F.floor(F.size(v) * F.lit(cut)).cast("int"),
        lambda k: mean(F.slice(v, k + 1, F.greatest(F.size(v) - 2 * k, F.lit(0))))))


def mean_abs_deviation(a: Column) -> Column:
    return let(known(a), lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: F.abs(x - m)))))


def median_abs_deviation(a: Column) -> Column:
    return let(known(a), lambda v: let(median(v), lambda m: median(F.transform(v, lambda x: F.abs(x - m)))))


def adjacent(a: Column, f) -> Column:
    """f(previous, next) for each neighbouring pair of elements."""
    return let(a, lambda v: let(F.greatest(F.size(v) - 1, F.lit(0)), lambda k: F.zip_with(
        F.slice(v, 1, k), F.slice(v, F.lit(2), k), f)))


def differences(a: Column) -> Column:
    return adjacent(a, lambda x, y: y - x)


def transition_rate(a: Column) -> Column:
    """Share of neighbouring known pairs whose states differ."""
    return mean(adjacent(a, lambda x, y: (x != y).cast("double")))


def pair_count(a: Column, before, after) -> Column:
    """Number of neighbours going from state ``before`` to state ``after``."""
    return count_if(adjacent(a, lambda x, y: (x == before) & (y == after)), lambda t: t)


def corr(pairs: Column, min_n: int = 2) -> Column:
    """Pearson correlation of an array of (x, y) structs; incomplete pairs are skipped."""
    full = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def body(v):
        mx = mean(F.transform(v, lambda p: p["x"]))
        my = mean(F.transform(v, lambda p: p["y"]))
        return let(F.struct(mx.alias("mx"), my.alias("my")), lambda m: let(
            F.aggregate(
                v,
                F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0.0).alias("xy")),
                lambda s, p: F.struct(
                    (s["xx"] + (p["x"] - m["mx"]) * (p["x"] - m["mx"])).alias("xx"),
                    (s["yy"] + (p["y"] - m["my"]) * (p["y"] - m["my"])).alias("yy"),
                    (s["xy"] + (p["x"] - m["mx"]) * (p["y"] - m["my"])).alias("xy"),
                ),
            ),
            lambda s: F.when(
                (F.size(v) >= min_n) & (s["xx"] > 1e-20) & (s["yy"] > 1e-20),
                s["xy"] / F.sqrt(s["xx"] * s["yy"]),
            )))

    return let(full, body)


def xy(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))


def acf1(a: Column, min_n: int = 2) -> Column:
    """Pearson correlation of the series with itself one position later."""
    return corr(adjacent(a, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), min_n)


def slope(y: Column, x: Column | None = None, min_n: int = 3) -> Column:
    """Least-squares slope of y on x (default: position), missing y skipped."""
    xs = positions(F.size(y)) if x is None else x
    pairs = F.filter(xy(xs, y), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def body(v):
        return let(mean(F.transform(v, lambda p: p["x"])), lambda mx: let(
            F.aggregate(
                v,
                F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy")),
                lambda s, p: F.struct(
                    (s["xx"] + (p["x"] - mx) * (p["x"] - mx)).alias("xx"),
                    (s["xy"] + (p["x"] - mx) * p["y"]).alias("xy"),
                ),
            ),
            lambda s: F.when((F.size(v) >= min_n) & (s["xx"] > 1e-12), s["xy"] / s["xx"])))

    return let(pairs, body)


def runs(a: Column) -> Column:
    """Maximal runs of equal neighbours as array<struct<start, length, value>>."""

    def body(v):
        starts = F.filter(positions(F.size(v)), lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
        return let(starts, lambda s: F.zip_with(
            s,
            F.slice(F.concat(s, F.array(F.size(v))), F.lit(2), F.size(s)),
            lambda i, j: F.struct(i.alias("start"), (j - i).alias("length"), F.get(v, i).alias("value")),
        ))

    return let(a, body)


def run_lengths(a: Column, predicate) -> Column:
    """Lengths of the maximal runs whose elements satisfy the predicate."""
    flags = F.transform(a, lambda x: F.coalesce(predicate(x), F.lit(False)))
    return F.transform(F.filter(runs(flags), lambda r: r["value"]), lambda r: r["length"])


def longest_run(a: Column, predicate) -> Column:
    return F.coalesce(F.array_max(run_lengths(a, predicate)), F.lit(0))


def entropy_of_counts(counts: Column, base: float = math.e) -> Column:
    """Shannon entropy of an array of counts."""
    return let(
        F.filter(counts, lambda c: c > 0),
        lambda v: let(total(F.transform(v, lambda c: c.cast("double"))), lambda n: F.when(
            n > 0,
            F.aggregate(v, F.lit(0.0), lambda s, c: s - (c / n) * F.log(c / n) / F.lit(math.log(base))))))


def code_counts(a: Column) -> Column:
    return let(known(a), lambda v: F.transform(
        F.array_distinct(v), lambda k: F.size(F.filter(v, lambda x: x == k))))


def code_entropy(a: Column) -> Column:
    return entropy_of_counts(code_counts(a))


def histogram_counts(a: Column, bins: int) -> Column:
    """Counts in equal-width bins between min and max, last bin closed; NULL for constant input."""

    def body(v):
        return let(F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi")), lambda m: F.when(
            m["hi"] > m["lo"],
            let(
                F.transform(v, lambda x: F.least(
                    F.floor((x - m["lo"]) / (m["hi"] - m["lo"]) * bins).cast("int"), F.lit(bins - 1))),
                lambda b: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(b, lambda x: x == k))),
            )))

    return let(known(a), body)


def histogram_entropy(a: Column, bins: int = 16) -> Column:
    return entropy_of_counts(histogram_counts(a, bins))


def edge_counts(v: Column, edges: Column) -> Column:
    """Counts between consecutive edges, last interval closed on the right."""
    return let(edges, lambda e: F.transform(
        positions(F.greatest(F.size(e) - 1, F.lit(0))),
        lambda i: F.size(F.filter(v, lambda x: (x >= F.get(e, i)) & (
            (x < F.get(e, i + 1)) | ((i == F.size(e) - 2) & (x == F.get(e, i + 1))))))))


def quantile_entropy(a: Column, bins: int = 8, min_n: int = 5) -> Column:
    """Entropy over equal-frequency bins divided by the log of the bins in use."""

    def body(v):
        edges = F.array_distinct(F.array(*[quantile(v, i / bins) for i in range(bins + 1)]))
        counts = F.filter(edge_counts(v, edges), lambda c: c > 0)
        return F.when(
            (F.size(v) >= min_n) & (F.array_max(v) - F.array_min(v) > 1e-12),
            let(edges, lambda e: F.when(F.size(e) >= 3, let(
                counts, lambda c: F.when(F.size(c) > 1, entropy_of_counts(c) / F.log(F.size(c))).otherwise(0.0)))))

    return let(ordered(a), body)


def transition_entropy(a: Column, states) -> Column:
    """Occupancy-weighted row entropy in bits of the state transition matrix."""
    pairs = adjacent(a, lambda x, y: F.struct(x.alias("f"), y.alias("t")))

    def body(p):
        def row(k):
            mine = F.filter(p, lambda z: z["f"] == k)
            return let(mine, lambda m: F.size(m) * F.coalesce(entropy_of_counts(F.array(*[
                F.size(F.filter(F.transform(m, lambda z: z["t"]), is_code(j))) for j in states]), 2.0), F.lit(0.0)))

        valid = F.size(p)
        return F.try_divide(sum((row(k) for k in states[1:]), row(states[0])), valid)

    inside = F.filter(pairs, lambda z: z["f"].isin(*states) & z["t"].isin(*states))
    return let(inside, body)


def pad_or_truncate(a: Column, n: int, pad: float = -1.0) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), n)), 1, n)


def blocks(a: Column, width: int) -> Column:
    """Split into consecutive blocks of ``width``; a short tail is dropped."""
    return let(a, lambda v: F.transform(
        positions((F.size(v) / width).cast("int")), lambda i: F.slice(v, i * width + 1, F.lit(width))))


def block_means(a: Column, width: int) -> Column:
    return F.transform(blocks(a, width), mean)


def first_mode(a: Column) -> Column:
    """Most frequent element; the one seen first wins ties."""
    return let(known(a), lambda v: let(F.array_distinct(v), lambda d: let(
        F.transform(d, lambda k: F.size(F.filter(v, lambda x: x == k))),
        lambda c: F.get(d, (F.array_position(c, F.array_max(c)) - 1).cast("int")))))


def block_modes(a: Column, width: int) -> Column:
    return F.transform(blocks(a, width), first_mode)


def rolling(a: Column, width: int, f, min_n: int = 1) -> Column:
    """f over each trailing window of positions; NULL below ``min_n`` known elements."""
    return let(a, lambda v: F.transform(positions(F.size(v)), lambda i: let(
        F.slice(v, F.greatest(i - (width - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(width))),
        lambda w: F.when(F.size(known(w)) >= min_n, f(w)))))


def full_windows(a: Column, width: int, f) -> Column:
    """f over each complete window of ``width`` elements."""
    return let(a, lambda v: F.transform(
        positions(F.greatest(F.size(v) - (width - 1), F.lit(0))), lambda i: f(F.slice(v, i + 1, F.lit(width)))))


def circular_window_means(profile: Column, width: int) -> Column:
    """Mean of each window of ``width`` starting at every position of a cyclic profile."""
    return let(profile, lambda p: let(F.concat(p, p), lambda d: F.transform(
        positions(F.size(p)), lambda i: mean(F.slice(d, i + 1, F.lit(width))))))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return let(a, lambda v: F.array_position(v, F.array_max(v)) - 1)


def argmin(a: Column) -> Column:
    return let(a, lambda v: F.array_position(v, F.array_min(v)) - 1)


def interpolate(a: Column) -> Column:
    """Linear fill between known elements; edges hold the nearest known value."""

    def body(v):
        ks = F.filter(positions(F.size(v)), lambda i: F.get(v, i).isNotNull())

        def fill(k):
            inner = adjacent(k, lambda i, j: F.transform(
                F.sequence(i, j - 1),
                lambda t: F.get(v, i) + (F.get(v, j) - F.get(v, i)) * (t - i) / (j - i)))
            first, last = F.get(k, F.lit(0)), F.element_at(k, -1)
            return F.when(F.size(k) > 0, F.concat(
                F.array_repeat(F.get(v, first), first),
                F.flatten(inner),
                F.array_repeat(F.get(v, last), F.size(v) - last)))

        return let(ks, fill)

    return let(a, body)


def circular_interpolate(a: Column, min_known: int) -> Column:
    """Linear fill on a cyclic profile; NULL when fewer than ``min_known`` elements are known."""
    return let(a, lambda v: F.when(
        F.size(known(v)) >= min_known,
        F.slice(interpolate(F.concat(v, v, v)), F.size(v) + 1, F.size(v))))


def resample_ranks(a: Column, n_out: int) -> Column:
    """Values at ``n_out`` equally spaced positions of the known elements."""

    def body(v):
        def at(j):
            return let(F.lit(float(j)) / (n_out - 1) * (F.size(v) - 1), lambda h: let(
                F.floor(h).cast("int"),
                lambda lo: F.get(v, lo) + (F.get(v, F.least(lo + 1, F.size(v) - 1)) - F.get(v, lo)) * (h - lo)))

        return F.when(F.size(v) > 0, F.array(*[at(j) for j in range(n_out)]))

    return let(known(a), body)


def amplitudes(a: Column, ks: Column) -> Column:
    """|DFT| of a complete array at the harmonics listed in ``ks``."""

    def body(v):
        def part(k, f):
            return F.aggregate(
                F.zip_with(v, positions(F.size(v)), lambda x, i: x * f(2 * math.pi * k * i / F.size(v))),
                F.lit(0.0), lambda s, x: s + x)

        return F.transform(ks, lambda k: F.hypot(part(k, F.cos), part(k, F.sin)))

    return let(a, body)


def cosinor(a: Column, hours: Column) -> Column:
    """Least-squares 24 h cosinor: struct(mesor, cos_coef, sin_coef, amplitude)."""
    w = 2 * math.pi / 24
    points = F.zip_with(a, hours, lambda y, h: F.struct(
        y.alias("y"), F.cos(h * w).alias("c"), F.sin(h * w).alias("s")))
    names = ("n", "c", "s", "cc", "ss", "cs", "y", "yc", "ys")

    def add(t, p):
        term = {"n": F.lit(1.0), "c": p["c"], "s": p["s"], "cc": p["c"] * p["c"], "ss": p["s"] * p["s"],
                "cs": p["c"] * p["s"], "y": p["y"], "yc": p["y"] * p["c"], "ys": p["y"] * p["s"]}
        return F.struct(*[(t[k] + term[k]).alias(k) for k in names])

    sums = F.aggregate(
        F.filter(points, lambda p: p["y"].isNotNull()),
        F.struct(*[F.lit(0.0).alias(k) for k in names]), add)

    def solve(t):
        # Centre the three columns, then a 2 x 2 system remains.
        n = t["n"]
        cc, ss = t["cc"] - t["c"] * t["c"] / n, t["ss"] - t["s"] * t["s"] / n
        cs = t["cs"] - t["c"] * t["s"] / n
        yc, ys = t["yc"] - t["y"] * t["c"] / n, t["ys"] - t["y"] * t["s"] / n
        det = cc * ss - cs * cs
        b1, b2 = (yc * ss - ys * cs) / det, (ys * cc - yc * cs) / det
        return F.when((n >= 3) & (det > 1e-9), F.struct(
            ((t["y"] - b1 * t["c"] - b2 * t["s"]) / n).alias("mesor"),
            b1.alias("cos_coef"), b2.alias("sin_coef"), F.hypot(b1, b2).alias("amplitude")))

    guarded = let(sums, lambda t: F.when(t["n"] >= 3, let(t, solve)))
    return guarded


def densify(where: Column, vals: Column, n: int) -> Column:
    """Array of length n from sorted distinct positions and their values; gaps are NULL."""
    def gap(k):
        return F.array_repeat(F.lit(None).cast("double"), k)

    prev = F.concat(F.array(F.lit(-1)), where)
    body = F.zip_with(
        F.zip_with(F.slice(prev, 1, F.size(where)), where, lambda p, q: q - p - 1), vals,
        lambda k, v: F.concat(gap(k), F.array(v)))
    tail = F.lit(n - 1) - F.coalesce(F.element_at(where, -1), F.lit(-1))
    return F.concat(F.flatten(body), gap(tail))


def theil_sen(a: Column) -> Column:
    """Median of the slopes of all position pairs of one short, bounded array."""

    def body(v):
        ks = positions(F.size(v))
        pairs = F.flatten(F.transform(ks, lambda i: F.transform(
            F.filter(ks, lambda j: j > i), lambda j: (F.get(v, j) - F.get(v, i)) / (j - i))))
        return F.when(F.size(v) >= 3, median(pairs))

    return let(a, body)
