"""Operators against brute force and hand-made edge cases: nulls, empties, ties, repeats, long texts, odd columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barsmith.llm import components, minhash

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n ", "one", "one two", "a" * 3000, "é" * 900, "the same line\nthe same line\n" * 30,
    "password: hunter22, AKIA" + "A1" * 9 + " and " + "0f" * 15]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def edge_docs(spark):
    rows = [(i, t, "s" if i % 2 else None, "extra") for i, t in enumerate(EDGE)] + [(3, "one", "s", "extra"), (None, "null id text", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size string")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)}).encode())
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label, strict=True)]


@pytest.mark.parametrize(("width", "percent", "star", "chunk", "refine"), [(3, 85, 48, 400, 25), (5, 80, 2, 3, 25), (5, 80, 2, 2, 1)])
def test_minhash(spark, monkeypatch, width, percent, star, chunk, refine):
    monkeypatch.setattr(minhash, "REFINE", refine)
    docs = docs_of(spark).orderBy("doc_id").toPandas()
    base = docs.text[0].split()
    texts = [*docs.text, *(" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, min(len(base), 40), 4)), None, "", "one", "ONE", "one two"]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, percent, star=star,
        chunk=chunk).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, width, percent)


def test_minhash_with_and_without_the_filter(spark, monkeypatch):
    rows = docs_of(spark)
    want = sorted(map(tuple, minhash.near_duplicates(rows, 3, 85).collect()))
    monkeypatch.setattr(minhash, "FILTER_WORDS", 1)
    assert sorted(map(tuple, minhash.near_duplicates(rows, 3, 85).collect())) == want


def test_minhash_edges(spark):
    got = sorted(map(tuple, minhash.near_duplicates(edge_docs(spark)).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    shingle_counts = [1, 0, 0, 0, 1, 1, 1, 1, 1, 3, 1]
    ids = [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    assert [x[0] for x in got] == ids and [x[1] for x in got] == shingle_counts
    assert [x[2] for x in got] == ids and all(x[3] for x in got)
    empty = minhash.near_duplicates(empty_docs(spark))
    assert empty.count() == 0 and minhash.keep_one(empty_docs(spark)).count() == 0
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "v w x y z"), (2, "v w x y z"), (None, "a b c d e f"), (3, None)]
    rows = spark.createDataFrame([(i, t, i, "x") for i, t in texts], "doc_id long, text string, kept long, component_id string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(rows).collect()) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    left = minhash.keep_one(rows)
    assert left.columns == rows.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"),
        (1, "a b c d e f"), (1, "v w x y z"), (3, "")]


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
