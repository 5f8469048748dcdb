"""URL filter: rules, host parsing and exact membership against sets."""

import random

import pytest
from pyspark.sql import functions as F

from diurna.llm import urls


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(5)
    names = [f"k{i}" for i in range(4000)]
    listed = set(rng.sample(names, 700))
    keys = spark.createDataFrame([(k,) for k in names] + [(k,) for k in names[:50]], "key string")
    return keys, listed, spark.createDataFrame([(k,) for k in sorted(listed)], "key string")


@pytest.mark.parametrize(("first", "later"), [(1, 1), (2, 3), (None, 4)])
def test_cascade_is_exact_for_every_key_asked(spark, held, first, later):
    keys, listed, table = held
    c = urls.cascade(spark, table, keys, len(listed), first, later)
    assert len(c.levels) >= 2
    got = {r.key: r.hit for r in keys.select("key", c.has(F.col("key")).alias("hit")).collect()}
    assert {k for k, hit in got.items() if hit} == listed
    assert spark.range(1).select(c.has(F.lit(None).cast("string")).alias("x")).first().x is False


def test_filter_has_no_false_negative_and_the_declared_size(spark, held):
    keys, listed, table = held
    lv = urls.level(spark, table, len(listed), 0, 5)
    row = lv.words.first().words
    assert len(row) * 64 == lv.bits and lv.bits >= len(listed) * 5
    assert table.where(~lv.passes(F.col("key"))).count() == 0
    assert keys.where(lv.passes(F.col("key"))).distinct().count() - len(listed) < 400


ROWS = [
    (1, "http://A.Example.org/es/1?x=/en/", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    (4, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (5, "https://org?x", "org", "", None, "allow"),
    (6, "http://ads.example.com/de/", "ads.example.com", "/de/", "com/de/", "block"),
    (7, "http://ads.example.com/fr/", "ads.example.com", "/fr/", "com/fr/", "allow"),
    (8, "http://m.ads.net/x", "m.ads.net", "/x", None, "block"),
    (9, "http://mads.net/x", "mads.net", "/x", None, "allow"),
    (10, "http://page.net/bad", "page.net", "/bad", None, "block"),
    (11, "http://page.net/bad2", "page.net", "/bad2", None, "allow"),
    (12, None, "", "", None, "allow"),
    (13, "no scheme/org/", "", "", None, "allow"),
    (None, "x://y://ads.net/z", "y:", "//ads.net/z", None, "allow"),
    (15, "http://ÄDS.net/É", "ÄDS.net".replace("D", "d").replace("S", "s"), "/É", None, "allow"),
    (16, "", "", "", None, "allow"),
    (8, "http://m.ads.net/x", "m.ads.net", "/x", None, "block"),
    (17, "http://" + "a." * 300 + "ads.net/" + "p" * 100_000, "a." * 300 + "ads.net", "/" + "p" * 100_000, None, "block"),
]


@pytest.mark.parametrize("limit", [urls.LIMIT, 0])
def test_rules_and_list_in_memory_and_joined(spark, limit):
    pages = spark.createDataFrame([(r[0], r[1], "a", "b") for r in ROWS], "page_id bigint, url string, host string, key string")
    listed = spark.createDataFrame([("ads.net",), ("ads.example.com",), ("page.net/bad",), ("ads.net",), (None,), ("",)], "key string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filtered(pages, listed, limit=limit).collect()), key=str)
    assert got == sorted(((r[0], *r[2:]) for r in ROWS), key=str)


def test_longest_rule_wins_and_longer_host_on_ties(spark):
    rules = (urls.Rule("allow", "b", "/xyz"), urls.Rule("block", "a.b", "/"), urls.Rule("allow", "b", "/"))
    pages = spark.createDataFrame([(1, "s://a.b/xyz"), (2, "s://c.b/xyz"), (3, "s://a.b/y")], "page_id bigint, url string")
    none = spark.createDataFrame([], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filtered(pages, none, rules=rules).collect()}
    assert got == {1: ("b/xyz", "allow"), 2: ("b/xyz", "allow"), 3: ("a.b/", "block")}
    tie = (urls.Rule("allow", "b", "/xyz"), urls.Rule("block", "a.b", "/x" + "y"))
    assert {r.verdict for r in urls.filtered(pages.where("page_id = 1"), none, rules=tie).collect()} == {"block"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    listed = spark.createDataFrame([("ads.net",)], "key string")
    assert urls.filtered(empty, listed).collect() == []
    assert urls.filtered(empty, urls.suspects(empty)).collect() == []


def test_suspects_are_names_whose_first_label_has_a_word(spark):
    pages = spark.createDataFrame([(1, "s://www.ads-x.net/"), (2, "s://adsx.net/"), (3, "s://a.b.casino.com/q"), (4, None)], "page_id bigint, url string")
    assert {r.key for r in urls.suspects(pages).collect()} == {"ads-x.net", "casino.com"}


def test_main_path_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://m.ads.net/x")], "page_id bigint, url string")
    plan = urls.filtered(pages, urls.suspects(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan.split("Subqueries")[0]
