"""Helpers on DataFrames shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.sources.files import materialise

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 1 << 20  # bytes of an Arrow batch; a longer row is one batch


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns under new names, found by exact spelling and first position, so extra or clashing columns do no harm."""
    where = {name: df.columns.index(source) for name, source in columns.items()}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(name) for name, i in where.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors, gives Catalyst real sizes."""
    return materialise(df, name)


def in_batches(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH bytes instead of 10,000 rows of any length.

    The executor and its worker each hold a batch several times over, outside the heap, and keep that
    memory. The setting is the session's, as plans read it when they run; one made before is left alone.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, str(BATCH))
    return rows.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sketch(*parts: Column) -> Column:
    """60 pseudo-random bits of the parts, from md5, so that another engine can repeat them."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
