"""Missing-value and numeric rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no value" in the raw exports.
MISSING_TOKENS = ("", "...", "nan", "none", "null")


def known(c: Column) -> Column:
    """NaN and infinities become NULL; everything else is unchanged."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Text to double; unparsable, NaN and infinite become NULL."""
    return known(F.trim(c).try_cast("double"))


def blank_to_null(c: Column, tokens=MISSING_TOKENS) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*tokens), c)


def ratio(a, b, eps: float = 1e-12) -> Column:
    """a / b, NULL when |b| is not above eps."""
    return F.when(F.abs(b) > eps, F.try_divide(a, b))


def clip(c: Column, lo, hi) -> Column:
    """NULL-preserving clip."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def power_skew(n, s1, s2, s3) -> Column:
    """Population skewness from power sums."""
    m = s1 / n
    var = s2 / n - m * m
    return F.when(var > 1e-24, (s3 / n - 3 * m * s2 / n + 2 * m * m * m) / F.pow(var, F.lit(1.5)))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation over complete pairs; NULL, not an error, when one side is constant.

    ``F.corr`` divides inside the aggregate, before any condition around it is looked at.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
