"""Language identification by known words, with back-off to shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unseen word is scored
by the mean log frequency of its known character n-grams of the longest length (4, 3, 2, 1, with
word edges marked) at which any is known. The model is fitted on a bounded sample of labelled rows
and has a bounded number of words and n-grams, so it is small enough to be sent to every task; all
rows are then labelled in one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.llm.frames import documents, in_batches, pick, sketch
from diurna.llm.registry import llm_query

MAX_ROWS, MAX_WORDS, MAX_GRAMS = 20_000, 40_000, 40_000
LONGEST = 4
SMOOTH = 0.5
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """``words`` and ``grams`` map to rows of log frequencies, one column per language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return self.gram_logs[known].mean(0)
        return np.zeros(len(self.langs))


def fit(df: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on at most about ``max_rows`` labelled rows, drawn by a hash of the id (the documented bound).

    Rows without text or label are left out. The words and n-grams kept are the most frequent ones.
    """
    rows = pick(df, doc_id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    n = rows.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = rows.where(sketch(F.lit("fit"), F.col("doc_id")) < int(share * (1 << 60))) if share < 1 else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def counted() -> pa.RecordBatch:
            cols = list(zip(*[(lang, w, c) for lang, cs in seen.items() for w, c in cs.items()], strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

        for b in batches:  # batches are small: counts run on over them
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > CACHE:
                yield counted()
                seen.clear()
        yield counted()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, word, c in zip(b["lang"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
                for k in range(1, LONGEST + 1):
                    for g in grams_of(word, k):
                        seen[lang, g] += c
            cols = list(zip(*[(lang, g, c) for (lang, g), c in seen.items()], strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    schema = "lang string, word string, n bigint"
    words = in_batches(sample.select("lang", "text"), count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    grams = in_batches(words, pieces, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    langs = sorted(totals)

    def table(counts: DataFrame, most: int, by_length: bool) -> tuple[dict[str, int], np.ndarray]:
        """The ``most`` most frequent entries (the model's bound) as log frequencies."""
        top = counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        kept = top.orderBy(F.desc("all"), "word").limit(most).collect()
        sums: Counter = Counter()
        for r in counts.groupBy("lang", F.length("word").alias("k")).agg(F.sum("n").alias("n")).collect() if by_length else []:
            sums[r.lang, r.k] = r.n
        logs = np.empty((len(kept), len(langs)))
        for i, r in enumerate(kept):
            for j, lang in enumerate(langs):
                base = sums[lang, len(r.word)] if by_length else totals[lang]
                logs[i, j] = math.log((r.by.get(lang, 0) + SMOOTH) / (base + SMOOTH * most))
        return {r.word: i for i, r in enumerate(kept)}, logs

    word_ids, word_logs = table(words.where("n > 1"), max_words, False)
    gram_ids, gram_logs = table(grams, max_grams, True)
    words.unpersist()
    grams.unpersist()
    return Model(langs, word_ids, gram_ids, word_logs, gram_logs)


def score(model: Model, words: list[str], rows: np.ndarray | None = None) -> tuple[str, float]:
    """(language, confidence): softmax over the languages of the summed logs, tempered so that 20 words count fully."""
    vectors = rows if rows is not None else np.array([model.vector(w) for w in words])
    total = vectors.sum(0) / max(1.0, len(vectors) / 20)
    p = np.exp(total - total.max())
    p /= p.sum()
    best = int(p.argmax())
    return model.langs[best], float(p[best])


def identify(df: DataFrame, model: Model, id_col="doc_id", text_col="text", keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, plus the input's columns before them if ``keep``.

    ``und`` with score 0 if the text is null, has no letters, or nothing was learned. Of languages
    with equal scores the first by name is named. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams
    place = df.columns.index(text_col) if keep else 1

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[str, int] = {}
        vectors = np.empty((1024, len(m.langs)))
        for b in batches:
            langs, scores = [], []
            for t in b.column(place):
                text = t.as_py()
                if text is None or not m.langs or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                words = words_of(text)
                if len(cache) > CACHE:
                    cache.clear()
                for w in set(words).difference(cache):
                    if len(cache) == len(vectors):
                        vectors = np.concatenate([vectors, np.empty_like(vectors)])
                    vectors[len(cache)] = m.vector(w)
                    cache[w] = len(cache)
                lang, s = score(m, words, vectors[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]) if words else ("und", 0.0)
                langs.append(lang)
                scores.append(s)
            kept = b.num_columns if keep else 1
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:kept], "lang_pred", "score"])

    if keep:
        rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # the text goes to Python once
        fields = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(df.dtypes))
    else:
        rows = pick(df, doc_id=id_col, the_text=text_col)
        fields = f"doc_id {rows.dtypes[0][1]}"
    return in_batches(rows, predict, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def learned(docs: DataFrame) -> Model:
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return fit(rows.where(~F.coalesce(held_out(), F.lit(False))))


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in a recognised language: not ``und`` and scored at least ``least``."""
    marked = identify(docs, learned(docs), keep=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return marked.drop("lang_pred", "score").toDF(*docs.columns)


@llm_query("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = identify(docs, learned(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
