"""The curriculum against a walk over the sorted documents, and its defined results on odd rows."""

import hashlib
from collections import defaultdict

import pytest

from barsmith.llm import mixing
from tests.llm.test_operators import EDGE, WORD, docs_of, edge_docs, empty_docs


def demand(t: float, slope: float) -> float:
    """Share of a source's words asked for until time t, by summing its rate over small steps."""
    steps = 20_000
    return sum((1 + slope * (2 * (k + 0.5) * t / steps - 1)) * t / steps for k in range(steps))


def by_hand(rows):
    """(doc_id: (size, source size, target, positions)) of rows (doc_id, text, source)."""
    size = {i: len(WORD.findall((t or "").encode())) for i, t, _ in rows}
    of_source = defaultdict(list)
    for i, _, s in rows:
        of_source[s].append(i)
    names = sorted((s for s in of_source if s is not None), key=lambda s: s.encode()) + [None] * (None in of_source)
    total = sum(size.values())
    own = {s: sum(size[i] for i in of_source[s]) for s in names}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    free, target, left = set(names), {}, total
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * own[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * own[s]
            left -= target[s]
        free -= over
    out = {}
    for k, s in enumerate(names):
        slope, before = mixing.SLOPES[k % 3], 0
        for i in sorted(of_source[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            middles = [c * own[s] + before + size[i] / 2 for c in range(3)] if size[i] else []
            out[i] = (size[i], own[s], target[s], [(m / target[s], slope) for m in middles if m < target[s]])
            before += size[i]
    return out


@pytest.mark.parametrize("rows_a_bucket", [7, 1000])
def test_positions_and_places(spark, rows_a_bucket):
    rows = [(r.doc_id, r.text, r.source) for r in docs_of(spark).collect()]
    want = by_hand(rows)
    got = {r.doc_id: r for r in mixing.positions(docs_of(spark), rows_a_bucket).select("doc_id", "__mix.*").collect()}
    for i, (size, of_source, target, copies) in want.items():
        r = got[i]
        assert (r["size"], r.source_size, len(r.positions)) == (size, of_source, len(copies)) and abs(r.target - target) < 1e-6
    for i in list(want)[:25]:
        for p, (share, slope) in zip(got[i].positions, want[i][3], strict=True):
            assert 0 <= p <= 1 and abs(demand(p, slope) - share) < 1e-6
    order = sorted((p, hashlib.md5(str(i).encode()).hexdigest(), i) for i, r in got.items() for p in r.positions)
    placed = {r.doc_id: r for r in mixing.training_order(docs_of(spark), rows_a_bucket).collect()}
    for k, (p, _, i) in reversed(list(enumerate(order))):
        want_place = k if p == got[i].positions[0] else None
        if want_place is not None:
            assert (placed[i].first_place, placed[i].first_position, placed[i].last_position, placed[i].taken) == (k, p, got[i].positions[-1],
                got[i]["size"] * len(got[i].positions))
    assert [r.doc_id for r in mixing.curriculum(docs_of(spark), rows_a_bucket).collect()] == [i for _, _, i in order]


def test_each_source_comes_near_its_target(spark):
    placed = mixing.positions(docs_of(spark)).select("source", "__mix.*").collect()
    largest = max(r["size"] for r in placed)
    for s in {r.source for r in placed}:
        own = [r for r in placed if r.source == s]
        assert abs(sum(r["size"] * len(r.positions) for r in own) - own[0].target) <= largest


def test_a_slope_changes_the_order(spark, monkeypatch):
    before = {r.doc_id: r.first_place for r in mixing.training_order(docs_of(spark)).collect()}
    monkeypatch.setattr(mixing, "SLOPES", (0.0, 0.0, 0.0))
    assert before != {r.doc_id: r.first_place for r in mixing.training_order(docs_of(spark)).collect()}


def test_caps(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 20)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["c"] == 30 and got["a"] == 30 and got[None] == 60 and got["b"] == 1040 - 120


def test_odd_rows(spark):
    docs = edge_docs(spark)
    got = mixing.training_order(docs).collect()
    assert len(got) == len(EDGE) + 2
    for r in got:
        assert (r.first_place is None) == (r.taken == 0) and (r["size"] > 0 or r.taken == 0)
    sizes = {r.doc_id: r["size"] for r in got}
    assert sizes[0] == sizes[1] == sizes[2] == 0 and sizes[5] == 1 and sizes[7] == 180 and sizes[None] == 3
    assert [r["size"] for r in got if r.doc_id == 3] == [1, 1]
    order = mixing.curriculum(docs)
    assert order.columns == docs.columns and order.count() == sum(r.taken // r["size"] for r in got if r.taken)
    places = sorted(r.first_place for r in got if r.first_place is not None)
    assert len(set(places)) == len(places) and max(places) < order.count()


def test_empty_table(spark):
    assert mixing.training_order(empty_docs(spark)).count() == 0 and mixing.curriculum(empty_docs(spark)).count() == 0
