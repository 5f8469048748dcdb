"""Pipeline stages that filter, on empty tables and on rows without text."""

import pytest

import corpus_pipeline
from diurna.llm import jaccard, language

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "ngram_jaccard", "mixing"])
def test_stage_of_an_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, "")
    assert out.columns == empty.columns and out.collect() == []


def test_representatives_of_rows_without_text(spark):
    d = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", None, None, 7), (4, "one two", "en", "b", 7)], SCHEMA)
    assert sorted(r.doc_id for r in jaccard.representatives(d).collect()) == [1, 2, 3]
    assert language.accepted(d.where("doc_id < 3")).collect() == []
