"""Suffix dedup against counting every window, the sort against sorted(), shared passages against all word windows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from barsmith.llm import suffixes
from tests.llm.test_operators import EDGE, SF, WORD, edge_docs, empty_docs


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        cov = np.cumsum(m)[: len(b)] > 0
        out.append((int(cov.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cov])).hexdigest()))
    return out


def test_deep_shallow_sorts():
    rng = random.Random(1)
    for shallow in (0, 8, 64):
        s = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(80)})
        order, shared = suffixes.deep_shallow(s, shallow)
        ranked = sorted(s)
        assert [s[i] for i in order] == ranked
        assert shared[1:] == [suffixes._common(a, b) for a, b in zip(ranked, ranked[1:])]


@pytest.mark.parametrize("group", [1000, 4])
def test_suffix_dedup_brute_force(spark, group):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(20))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) + (passage if rng.random() < 0.5 else "")
        + " ".join(rng.choice(vocabulary[:6]) for _ in range(20)) for _ in range(80)] + ["a" * 200, "", None, "x" * 39]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.dedup(rows, 40, 10, group).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == brute_removed(texts, 40)


def test_suffix_dedup_edges(spark):
    got = suffixes.dedup(edge_docs(spark)).collect()
    assert len(got) == len(EDGE) + 2
    assert {(r.doc_id, r.n_removed) for r in got if r.n_removed} == {(5, 3000), (6, 1800), (7, 840)}
    assert suffixes.dedup(empty_docs(spark)).count() == 0


def test_long_runs_and_periods(spark):
    """Neighbouring rows of one class are one: few rows for a long run, the same result."""
    texts = ["a" * 5000, "ab" * 2000, "xyz" * 900 + "tail" + "a" * 100, "b" * 39, "c" * 41, "q" + "a" * 45 + "r", ("0123456789" * 7 + "\n") * 20]
    got = suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40, 10, 4, 6, 3).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == brute_removed(texts, 40)
    rows = spark.createDataFrame([(1, "a" * 300_000)], "doc long, text string").mapInArrow(suffixes._anchor_rows(400, 100), suffixes._ROWS).collect()
    assert len(rows) == 1 and (rows[0]["rows"], rows[0].reach) == (299_601, 299_600)


def test_repeated_and_null_ids(spark):
    text = "".join(random.Random(8).choice("abcdefgh") for _ in range(60))
    rows = [(1, text), (1, text), (2, "other"), (None, "z" + text), (None, None)]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 40, 10).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (5, 0), (60, 60), (60, 60), (61, 60)]


def words_of(text):
    return WORD.findall((text or "").encode())


def test_shared_passages(spark):
    """Every passage of the window's length in two documents is met; nothing is that no other document holds `core` words of."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(n) for n in (60, 51, 50, 30, 24)]
    texts = [f"{some(rng.randint(0, 40))} {rng.choice(passages) if rng.random() < 0.5 else ''}\n{some(rng.randint(0, 80))}" for _ in range(60)]
    texts += [(some(55) + "\n") * 2, None, "", some(49)]
    got = {r.doc_id: r.n_passage_words for r in suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def covered(width):
        seen = defaultdict(set)
        for i, t in enumerate(texts):
            w = words_of(t)
            for k in range(len(w) - width + 1):
                seen[tuple(w[k : k + width])].add(i)
        out = []
        for t in texts:
            w = words_of(t)
            places = {k + x for k in range(len(w) - width + 1) if len(seen[tuple(w[k : k + width])]) > 1 for x in range(width)}
            out.append(len(places))
        return out

    for i, (least, most) in enumerate(zip(covered(suffixes.WINDOW_WORDS), covered(suffixes.CORE_WORDS), strict=True)):
        assert got[i] <= most and (got[i] > 0 or least == 0), i
    assert max(got.values()) >= 50 and got[60] == got[61] == got[62] == got[63] == 0


def test_query(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = suffixes.op2_suffix_dedup(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == brute_removed(texts, 400)
    assert [r.n_bytes for r in got] == [len(t.encode()) for t in texts] and all((r.n_spans > 0) == (r.n_removed > 0) for r in got)
