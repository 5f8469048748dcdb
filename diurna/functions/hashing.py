"""Seeded, engine-independent pseudo-randomness.

Every random choice is a function of (seed, id), so a lost executor recomputes
exactly the same rows and another SQL engine can replay the draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(*parts) -> Column:
    """md5 of the parts joined by '-'; literals and columns may be mixed."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("-", *cols))


def hash_int(*parts) -> Column:
    """First 32 bits of the seeded md5 as a bigint."""
    return F.conv(F.substring(seeded_md5(*parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform number in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)
