"""Links of the int8 tiles against all cosines in double precision."""

import numpy as np
import pytest

from barsmith.llm import vectors
from barsmith.llm.common import least_labels

SCHEMA = "vec_id long, embedding array<double>, label string"


def by_hand(x: np.ndarray, threshold: float = 0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    return [(int(n), int(c)) for n, c in zip(linked.sum(1), least_labels(len(x), *np.nonzero(linked)), strict=True)]


@pytest.mark.parametrize(("dims", "noise"), [(16, 0.09), (64, 0.16), (1500, 0.22)])
def test_all_pairs(spark, dims, noise):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, dims))
    x = np.array([base[i % 12] + rng.normal(size=dims) * noise for i in range(90)] + [base[0]] * 3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=10, least_blocks=3).collect()}
    want = by_hand(x)
    assert 0 < sum(n for n, _ in want) < 92 * 93
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(93)] == [(n, c, c == i) for i, (n, c) in enumerate(want)]


def test_bounds_hold_and_doubt_is_rare():
    rng = np.random.default_rng(7)
    u = vectors.units(rng.normal(size=(300, 64)) + 3 * rng.normal(size=(1, 64)))
    cosine = u @ u.T
    parts = vectors.quantised(u)
    assert parts[0].dtype == np.int8
    certain, doubt = set(), set()
    for i, j, sure in vectors.judged(parts, parts, True, 0.95):
        certain |= set(zip(i[sure].tolist(), j[sure].tolist(), strict=True))
        doubt |= set(zip(i[~sure].tolist(), j[~sure].tolist(), strict=True))
    links = {(i, j) for i, j in zip(*np.nonzero(np.triu(cosine >= 0.95, 1)), strict=True)}
    assert certain <= links <= certain | doubt and all(abs(cosine[i, j] - 0.95) < 0.05 for i, j in doubt)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 2, [nan, 1.0], [None, 1.0], [], [inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(100 + i, v, None) for i, v in enumerate(odd)]
    rows += [(1, [1e-200, 0.0], ""), (2, [2e-200, 0.0], ""), (3, [1e200, 1.0], ""), (4, [2e200, 1.0], ""), (5, [0.0, 5e-324], ""), (6, [0.0, 1e308], "")]
    rows += [(7, [-1.0, 0.0], ""), (7, [-1.0, 0.0], ""), (8, [-1.0, -1.0], ""), (8, [0.0, -1.0], ""), (9, [-1.0, -1.001], ""), (None, [-1.0, -1.0], "")]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(x for x in got if (x[0] or 0) >= 100) == [(100 + i, 0, 100 + i, True) for i in range(len(odd))]
    links = {i: (n, c) for i, n, c, _ in got if i is not None and i < 7}
    assert links == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}
    assert [x for x in got if x[0] == 7] == [(7, 1, 7, True)] * 2
    assert {x[2] for x in got if x[0] in (8, 9)} == {8} and (None, 0, None, True) in got


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
