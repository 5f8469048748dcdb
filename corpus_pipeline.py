"""The corpus pipeline: language, exact and near duplicates, source weights, segmentation.

Every stage reads its predecessor's rows from Parquet and returns the rows it keeps with the columns
of ``documents``; the last returns the segmented rows. Rows equal in id and text may repeat after
the mix, which takes documents up to three times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import exact, jaccard, language, mixing, segmentation
from diurna.llm.frames import stored
from diurna.llm.registry import llm_query


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a recognised language."""
    return language.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts."""
    return exact.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, source and sampled pieces of every row."""
    rows = segmentation.encode(docs)
    return rows.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("mixing", source_mix),
    ("sentencepiece", sentencepiece),
]

# Language identification, SentencePiece and the components' closure over whole texts have no SQL form.
ORACLE_SQL = None


@llm_query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
