"""Base statistics by hand, the ratio against unhashed counts, the threshold on labels that never fit the target."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barsmith.llm import quality
from tests.llm.test_operators import EDGE, SF, WORD, docs_of, edge_docs, empty_docs


def test_base_statistics(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs_of(spark), labels).collect()}
    for d in docs_of(spark).collect():
        t = d.text
        w = [x.decode() for x in WORD.findall(t.encode())]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x.encode())]
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def grams(text):
    w = [x.decode() for x in WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}).encode())]
    return [(x,) for x in w] + list(zip(w, w[1:]))


def test_ratio_without_hashing(spark):
    """With so many buckets that hardly any n-grams share one, scores are those of plain counts."""
    buckets = 1 << 22
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(None, "A null id"), (2**62 + 1, "wide id"), (2**62, "WIDE id again")],
        "doc_id long, text string")
    some = spark.createDataFrame([(r.doc_id, 1, 0) for r in rows[:12]] + [(2**62 + 1, 1, 0), (None, 1, 0), (rows[20].doc_id, 1, 0),
        (rows[20].doc_id, 0, 0)], "doc_id long, quality int, toxic int")
    fits = {r.doc_id for r in some.filter(~quality.held_out()).collect()} - {None, rows[20].doc_id}
    assert 2 < len(fits) < 13
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    raw, target = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t))
        if i in fits:
            target.update(grams(t))
    share = sum(target.values()) / sum(raw.values())
    for r, (i, t) in zip(quality.judge(docs, some, buckets=buckets).collect(), texts, strict=True):
        g = grams(t)
        want = sum(math.log((target[x] + 2) / (raw[x] * share + 2)) for x in g) / len(g)
        assert r.doc_id == i and abs(r.llr - want) < 0.01, (r.llr, want)


@pytest.mark.parametrize(("folder", "least", "most"), [("/root/testdata/sf0.01", 10, 0.1), ("/root/testdata/check_s", 300, 0.02)])
def test_threshold_on_held_out_labels(spark, folder, least, most):
    """Good documents that never fit the target are kept, bad ones rejected, on small tables as on large ones."""
    if not os.path.exists(folder):
        pytest.skip("not here")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("NOT base_failed")
    unseen = labels.filter(quality.held_out()).join(judged, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"),
        F.count(F.lit(1)).alias("n")).collect()
    got = {r.quality: (r.kept, r.n) for r in unseen}
    assert got[1][0] > 0.99 and got[0][0] < most and min(n for _, n in got.values()) > least


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(edge_docs(spark), labels).collect()
    assert len(got) == len(EDGE) + 2
    assert [r.llr is None for r in got[:4]] == [True, True, True, False] and all(r.base_failed and not r.kept for r in got[:3])
    assert quality.judge(edge_docs(spark), labels.limit(0)).filter("llr <> 0").count() == 0
    assert quality.judge(empty_docs(spark), labels.limit(0)).count() == 0
