"""Many matches in one text, and rows that share or repeat their ids."""

import hashlib
import re
import time

from diurna.llm import secrets


def test_time_grows_with_the_matches(spark):
    text = "é " + " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(30_000))
    d = spark.createDataFrame([(1, text, 9), (1, "token=abcdefgh", 9), (None, "token=abcdefgh", 9), (1, "token=abcdefgh", 9), (2, None, 9)], "doc_id bigint, text string, row int")
    t0 = time.time()
    got = {(r.doc_id, len(r.spans)): r.spans for r in secrets.scan(d).collect()}
    assert time.time() - t0 < 60
    assert sorted(got, key=str) == sorted([(1, 30_000), (1, 1), (None, 1), (2, 0)], key=str)
    assert [(s.at, s.end) for s in got[1, 30_000]] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
    assert secrets.scan(d).count() == 5
