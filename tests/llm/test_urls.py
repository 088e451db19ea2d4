"""URL verdicts by hand and against a search term by term."""

import random
import re

import pytest

from barsmith.llm import urls

#: (url, verdict, strict terms, soft weight)
CASES = [
    (None, "allow", 0, 0), ("", "allow", 0, 0), ("no scheme casino", "block", 1, 0), ("http://a.b/casinox", "allow", 0, 0),
    ("http://a.b/ads?free", "allow", 0, 2),
    ("http://a.b/ads?free#WIN", "block", 0, 3), ("http://a.b/poker-bonus", "block", 0, 3), ("http://a.b/poker/poker", "allow", 0, 2),
    ("http://a.b/ads/ads", "allow", 0, 1),
    ("https://EXAMPLE.com/en/77", "allow", 0, 0), ("https://x.example.com/en/6", "block", 0, 0), ("http://com?/en/", "allow", 0, 0),
    ("http://a.net/de/casino", "allow", 1, 0),
    ("casino", "block", 1, 0), ("éxxxé", "block", 1, 0), ("http://a.b/xxx" + "/long" * 50_000, "block", 1, 0),
]


def test_cases(spark):
    rows = [(k, u) for k, (u, *_) in enumerate(CASES)] + [(0, "http://a.b/xxx"), (0, "http://a.b/xxx"), (None, "ends in porn"), (None, "o starts")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert [(r.verdict, r.n_strict, r.soft_weight) for r in got[: len(CASES)]] == [tuple(c[1:]) for c in CASES]
    assert [r.verdict for r in got[len(CASES) :]] == ["block", "block", "block", "allow"]
    assert got[0].host == got[0].path == "" and got[0].rule is None


def test_random_urls_term_by_term(spark):
    rng = random.Random(2)
    parts = [t for t, _ in urls.VOCABULARY] + ["/", "-", ".", "é", "x", "7", "?", "AD", "Casino"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for k in range(800)]
    met = {r.page_id: (r.n_strict, r.soft_weight) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for k, u in rows:
        hits = [w for t, w in urls.VOCABULARY if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", u.lower())]
        assert met[k] == (hits.count(0), sum(hits))


def test_own_vocabulary_and_other_ids(spark):
    got = urls.judge(spark.createDataFrame([("p", "http://a.b/one-two"), ("q", "http://a.b/one")], "page_id string, url string"),
        [("one", 1), ("two", 1)], 2).collect()
    assert [(r.page_id, r.verdict) for r in got] == [("p", "block"), ("q", "allow")]
    with pytest.raises(ValueError, match="lower case"):
        urls.automaton((("Term", 0),))


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, verdict string")).count() == 0
