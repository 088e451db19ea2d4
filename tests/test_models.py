"""Models and experiments against plain numpy, and the contract of factories."""

import datetime as dt

import numpy as np
import pytest

from barsmith.operators import eligibility, models

SCHEMA = "target_date date, target_end_date date, code string, a double, b double, target_return double, label int"


def dataset(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 2)), 2)
    r = 0.02 * (x[:, 0] > 0.3) + 0.01 * x[:, 1] * (x[:, 0] <= 0.3) + rng.normal(size=n) * 0.005
    days = [dt.date(2024, 1, 1) + dt.timedelta(int(k)) for k in np.arange(n) // 60]
    rows = [(d, d, f"c{k}", float(v[0]), float(v[1]), float(t), int(t - 0.005 > 8 * 2.220446049250313e-16))
        for k, (d, v, t) in enumerate(zip(days, x, r, strict=True))]
    return spark.createDataFrame(rows, SCHEMA), x, r, np.array([y[-1] for y in rows])


def grown(x, y, depth, leaf, cuts, path=""):
    """A tree by hand: {path: (feature, threshold)} and leaf probabilities."""
    n, p = len(y), y.mean()
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = None
    if depth and n >= 2 * leaf and 0 < p < 1:
        for f in range(x.shape[1]):
            u = np.unique(x[:, f])
            if len(u) < 2:
                continue
            t = np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 2)[1:-1])) if len(u) > cuts else (u[:-1] + u[1:]) / 2
            for c in t:
                left = x[:, f] <= c
                if min(left.sum(), n - left.sum()) >= leaf:
                    gain = gini(y) - (left.sum() * gini(y[left]) + (n - left.sum()) * gini(y[~left])) / n
                    if best is None or gain > best[0]:
                        best = (gain, f, c, left)
    if best is None or best[0] <= 0:
        return {path: p}
    _, f, c, left = best
    return {path: (f, c)} | grown(x[left], y[left], depth - 1, leaf, cuts, path + "l") | grown(x[~left], y[~left], depth - 1, leaf, cuts, path + "r")


def predicted(tree, row, path=""):
    node = tree[path]
    return node if isinstance(node, float) else predicted(tree, row, path + ("l" if row[node[0]] <= node[1] else "r"))


@pytest.mark.parametrize(("cuts", "leaf"), [(32, 20), (400, 5)])
def test_tree_by_hand(spark, cuts, leaf):
    data, x, _, y = dataset(spark)
    fitted = models.MODELS["simple_decision_tree"].fit(data, ["a", "b"], "classification", max_depth=3, min_samples_leaf=leaf, max_thresholds=cuts)
    tree = grown(x, y, 3, leaf, cuts)
    got = {r.code: r.score for r in fitted.score(data).collect()}
    assert all(abs(got[f"c{k}"] - predicted(tree, v)) < 1e-12 for k, v in enumerate(x))
    assert abs(sum(fitted.importances.values()) - 1) < 1e-12 and fitted.importances["a"] > 0.3


def test_tree_of_one_class_is_a_leaf(spark):
    data, *_ = dataset(spark, 60)
    tree, weights = models.fit_tree(data.filter("label = 1"), ["a", "b"])
    assert tree == 1.0 and weights == {"a": 0.0, "b": 0.0}
    with pytest.raises(ValueError, match="no training rows"):
        models.fit_tree(data.limit(0), ["a", "b"])


def ridge(x, r, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / np.where(s > 0, s, 1)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (r - r.mean())) / np.where(s > 0, s, 1)
    return r.mean() - m @ w, w


def test_ridge_and_walk_forward(spark):
    data, x, r, _ = dataset(spark)
    fitted = models.fit_ridge(data, ["a", "b"], 2.0)
    c, w = ridge(x, r, 2.0)
    assert np.allclose([q.score for q in fitted.score(data.orderBy("target_date")).collect()],
        [q.score for q in data.withColumn("score", models._linear_score(c, w, ["a", "b"])).orderBy("target_date").collect()], atol=1e-10)
    start = dt.date(2024, 1, 8)
    got = {q.code: q for q in models.walk_forward_ridge(data, ["a", "b"], start, 1.0).collect()}
    assert len(got) == 180
    for k in (420, 470, 500, 599):
        day = k // 60
        c, w = ridge(x[: day * 60], r[: day * 60], 1.0)
        assert abs(got[f"c{k}"].score - (c + x[k] @ w)) < 1e-10 and got[f"c{k}"].training_samples == day * 60 and got[
            f"c{k}"].training_end_date == dt.date(2024, 1, day)


def test_constant_targets(spark):
    data, *_ = dataset(spark, 120)
    flat = data.withColumn("target_return", data.a * 0 + 0.25).withColumn("label", data.label * 0)
    for name, task, want in (("logistic_regression", "classification", 0.0), ("logistic_regression", "regression", 0.25),
        ("gradient_boosting_tree", "classification", 0.0)):
        fitted = models.MODELS[name].fit(flat, ["a", "b"], task, **models.model_parameters(name))
        assert {r.score for r in fitted.score(flat).collect()} == {want} and set(fitted.importances.values()) == {0.0}


def test_logistic_ranks_like_the_signal(spark):
    data, *_ = dataset(spark)
    out, weights = models.Experiment(["a", "b"], "logistic_regression", "classification", dt.date(2024, 1, 8), "single").run(data)
    rows = out.collect()
    hit = np.mean([r.prediction == r.label for r in rows])
    assert hit > 0.7 and weights["a"] > weights["b"] and {r.training_samples for r in rows} == {420}


def test_rolling_fits_before_each_date_and_only_eligible_rows(spark):
    data, *_ = dataset(spark, 360)
    marked = data.withColumn("eligible", data.code != "c0")
    out, weights = models.Experiment(["a", "b"], validation_start=dt.date(2024, 1, 5)).run(marked)
    got = {(r.target_date.day, r.training_samples, r.training_end_date.day) for r in out.collect()}
    assert got == {(5, 239, 4), (6, 299, 5)} and abs(sum(weights.values()) - 1) < 1e-9


def test_passthrough_needs_its_feature(spark):
    data, *_ = dataset(spark, 120)
    holes = data.withColumn("b", models.F.when(data.code != "c119", data.b))
    out, weights = models.Experiment(["a", "b"], "factor_passthrough", "regression", dt.date(2024, 1, 2), "single").run(holes)
    assert out.count() == 59 and out.filter("score <> b").count() == 0 and weights == {"a": 0.0, "b": 1.0}


def test_contract(spark):
    data, *_ = dataset(spark, 120)
    with pytest.raises(ValueError, match="labels differ"):
        models.Experiment(["a"], validation_start=dt.date(2024, 1, 2)).run(data.withColumn("label", 1 - data.label))
    with pytest.raises(ValueError, match="no samples from"):
        models.Experiment(["a"], validation_start=dt.date(2025, 1, 2), mode="single").run(data)
    for bad in ({"model": "nothing"}, {"model": "factor_passthrough"}, {"mode": "twice"}, {"parameters": {"max_depth": 0}},
        {"parameters": {"depth": 1}}, {"parameters": {"max_depth": True}}):
        with pytest.raises(ValueError):
            models.Experiment(["a"], **bad)
    with pytest.raises(ValueError, match="exists"):
        models.register_model("lightgbm", ("regression",))(None)
    with pytest.raises(ValueError, match="no feature at place"):
        models.finite_features(data, ["a"], (3,))


CONTEXT = ("execution_date date, code string, execution_open double, execution_close double, execution_pre_close double, execution_board string, "
    "execution_is_st boolean, execution_sessions_since_listing int, execution_has_corporate_action boolean, execution_suspended boolean")


def test_eligibility(spark):
    d = [dt.date(2024, 1, k) for k in range(1, 6)]
    rows = [(d[0], d[1], "UP"), (d[0], d[1], "DOWN"), (d[0], d[1], "OK"), (d[0], d[1], "HALT"), (d[0], d[1], "GONE"), (d[2], d[4], "LATE")]
    data = spark.createDataFrame(rows, "target_date date, target_end_date date, code string")
    row = lambda day, code, o, c, halt=False: (day, code, o, c, 10.0, "main", False, 100, False, halt)
    ctx = spark.createDataFrame([row(d[0], "UP", 11.0, 10.0), row(d[1], "UP", 10.0, 10.0), row(d[0], "DOWN", 10.0, 10.0),
        row(d[1], "DOWN", 10.0, 9.0), row(d[0], "OK", 10.99, 9.0), row(d[1], "OK", 11.0, 9.01), row(d[0], "HALT", 10.0, 10.0),
        row(d[1], "HALT", 10.0, 10.0, True)], CONTEXT)
    both = list(eligibility.FILTERS)
    marked = eligibility.mark_eligibility(data, ctx, both, cutoff=d[3])
    got = {r.code: (r.eligible, r.reason) for r in marked.collect()}
    assert got == {"UP": (False, "buy:limit_up_buy"), "DOWN": (False, "sell:limit_down_sell"), "OK": (True, ""),
        "HALT": (False, "sell:suspended_sell"), "GONE": (True, ""), "LATE": (True, "")}
    stats = {r["filter"]: (r.side, r.candidate_count, r.blocked_count, r.unknown_count) for r in eligibility.statistics(marked, both).collect()}
    assert stats == {"limit_up_buy": ("buy", 5, 1, 1), "limit_down_sell": ("sell", 5, 2, 1)}
    assert {r.code for r in eligibility.mark_eligibility(data, ctx, both, cutoff=d[3], missing="exclude").filter("NOT eligible").collect()} == {"UP",
        "DOWN", "HALT", "GONE"}
    with pytest.raises(ValueError, match="1 samples"):
        eligibility.checked(eligibility.mark_eligibility(data, ctx, both, cutoff=d[3], missing="error"))
    assert {r.reason for r in eligibility.mark_eligibility(data, ctx, ["limit_down_sell"], cutoff=d[3]).collect() if r.code == "UP"} == {""}
    assert eligibility.training_rows(marked).count() == 3
    for bad in (lambda: eligibility.mark_eligibility(data, ctx, ["x"]), lambda: eligibility.mark_eligibility(data, ctx, both, missing="x"),
        lambda: eligibility.training_rows(data), lambda: eligibility.Options(tick=0)):
        with pytest.raises(ValueError):
            bad()
