"""What a Python worker holds beside its rows stays small, so that workers fit beside a full heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from diurna.llm import jaccard, language, segmentation
from diurna.llm import words as W
from diurna.llm.frames import BATCH, BATCH_KEY, in_batches
from diurna.llm.pieces import load, pretokens


@pytest.fixture(scope="module")
def texts():
    """4 MB of text over 50,000 words in 2,000 rows."""
    r = np.random.default_rng(3)
    letters = r.integers(97, 123, (50_000, 9)).astype(np.uint8)
    words = [bytes(x[:n]).decode() for x, n in zip(letters, r.integers(3, 10, len(letters)), strict=True)]
    return pa.array([" ".join(words[i] for i in r.integers(0, len(words), 280)) for _ in range(2_000)])


def peak(run):
    """MB at most, beyond what was held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_segmentation_holds_little_beside_the_rows(texts):
    v = load()
    held = segmentation.Lattices(v, 1.0)

    def run():
        for t in pretokens(texts, v):
            segmentation.segment(t, held, np.arange(t.lo, t.hi, dtype=np.uint64))

    assert peak(run) < 80
    arrays = [held.limit, held.back, held.piece]
    assert sum(a.itemsize for a in arrays) <= 8  # an arc's


def test_shingles_hold_little_beside_the_rows(texts):
    W._powers.clear()

    def run():
        for c in W.chunks(texts, fold=True):
            jaccard.shingles(c, jaccard.SHINGLE)

    assert peak(run) < 20


def test_texts_go_to_the_language_model_once(spark, monkeypatch):
    seen = []
    frame = type(spark.range(0))
    real = frame.mapInArrow

    def noted(self, f, schema, *a, **k):
        seen.append([kind for _, kind in self.dtypes])
        return real(self, f, schema, *a, **k)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    model = language.Model(["de", "en"], {"und": 0, "and": 1}, {}, np.array([[-1.0, -9.0], [-9.0, -1.0]]), np.empty((0, 2)))
    docs = spark.createDataFrame([("and and", 1, "x"), (None, 2, "and"), ("und", 3, "and")], "body string, doc_id bigint, other string")
    out = language.identify(docs, model, text_col="body", keep=True)
    assert seen == [["string", "bigint", "string"]]
    got = {r[1]: (r[0], r[2], r.lang_pred) for r in out.collect()}
    assert got == {1: ("and and", "x", "en"), 2: (None, "and", "und"), 3: ("und", "and", "de")}


@pytest.fixture
def unset(spark):
    old = spark.conf.get(BATCH_KEY, None)
    spark.conf.unset(BATCH_KEY)
    yield spark
    spark.conf.unset(BATCH_KEY) if old is None else spark.conf.set(BATCH_KEY, old)


def test_batches_of_long_texts_are_bounded_in_bytes(unset):
    docs = unset.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd ', 8000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = in_batches(docs, sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in found) == 300
    assert max(r["size"] for r in found) < 1.2 * BATCH


def test_operators_bound_their_batches_and_keep_every_row(unset):
    docs = unset.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id % 30, ' next ', id % 30, ' '), 4000) AS text", "'de' AS lang")
    rows = docs.selectExpr("doc_id AS k", "doc_id", "text")
    model = language.Model(["de"], {"next": 0}, {}, np.array([[-1.0]]), np.empty((0, 1)))
    made = {
        "identify": lambda: language.identify(docs, model),
        "encode": lambda: segmentation.encode(docs),
        "profile": lambda: jaccard._profile(rows, jaccard.SHINGLE),
    }
    for name, run in made.items():
        unset.conf.unset(BATCH_KEY)
        out = run()
        assert unset.conf.get(BATCH_KEY, None) == str(BATCH), name
        got = sorted(map(str, out.collect()))
        unset.conf.set(BATCH_KEY, str(1 << 30))  # one batch; a setting made before is left alone
        whole = run()
        assert unset.conf.get(BATCH_KEY) == str(1 << 30)
        assert got == sorted(map(str, whole.collect())) and len(got) == 60, name


def test_word_counts_run_on_over_batches(unset, monkeypatch):
    docs = unset.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' next '), 8000) AS text", "concat('l', id % 2) AS lang")
    whole = language.fit(docs)
    unset.conf.set(BATCH_KEY, "1")  # a row is a batch
    sent, frame = [], type(unset.range(0))
    real = frame.mapInArrow

    def noted(self, f, schema, *a, **k):
        made = real(self, f, schema, *a, **k)
        sent.append(made)
        return made

    monkeypatch.setattr(frame, "mapInArrow", noted)
    small = language.fit(docs)
    assert sent[0].count() == 4  # two words of two languages
    assert (whole.langs, whole.words, whole.grams) == (small.langs, small.words, small.grams)
    assert np.array_equal(whole.word_logs, small.word_logs) and np.array_equal(whole.gram_logs, small.gram_logs)
