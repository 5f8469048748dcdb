"""Imports every operator module, which registers its query."""

from __future__ import annotations

from diurna.llm import (  # noqa: F401
    collocations,
    divergence,
    exact,
    jaccard,
    language,
    mixing,
    neighbours,
    secrets,
    segmentation,
    sharding,
    substrings,
    tokencounts,
    urls,
)
from diurna.llm.registry import ORACLE, QUERIES  # noqa: F401
