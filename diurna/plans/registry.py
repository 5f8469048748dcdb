"""Query registry: a Spark plan, its output columns and the SQL that confirms it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.plans.carrier_sql import CTES
from diurna.sources.carriers import Tables

# Moves exact decimal halves off the rounding edge, where the last bit of a sum would decide.
NUDGE = 2.7e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_carriers(sql: str) -> str:
    """Prefix the statement with the carrier views it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    ordered = needed  # depth first, so a view follows the views it reads
    if not ordered:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return head + "\n" + sql if not sql.lstrip().upper().startswith("WITH") else (
        head + ",\n" + re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    )


def query(name: str, s: str = "", i: str = "", f: str = "", sql: str | None = None, digits: int = 6):
    """Register a plan.

    ``s``, ``i`` and ``f`` name the text, integer and floating output columns; both
    engines cast to these types and round floats, so only values are compared.
    """

    def spark_cols():
        return (
            [F.col(c).cast("string").alias(c) for c in s.split()]
            + [F.col(c).cast("bigint").alias(c) for c in i.split()]
            + [(F.round(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) for c in f.split()]
        )

    def decorate(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir)).select(*spark_cols())

        run.__name__ = name
        run.section = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            cols = (
                [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in s.split()]
                + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i.split()]
                + [f'round(nullif(CAST("{c}" AS DOUBLE), CAST(\'nan\' AS DOUBLE)) + {NUDGE}, {digits}) + 0.0 AS "{c}"' for c in f.split()]
            )
            ORACLE[name] = f"SELECT {', '.join(cols)} FROM (\n{with_carriers(sql.strip())}\n) AS q"
        return fn

    return decorate
