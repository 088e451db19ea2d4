"""Models of an experiment: one contract, a registry, and walk-forward or single-fit runs over DataFrames.

fit(train, features, target) gives a Fitted: score(df) adds the column score, importances sum to 1 (or are all 0).
Classifiers score the probability of label 1, regressors a return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..shipping import ship
from .research import direction_label

FILL = -10000.0
TASKS = ("classification", "regression")


@dataclass
class Fitted:
    score: Callable[[DataFrame], DataFrame]
    importances: dict[str, float] | None = None


@dataclass(frozen=True)
class Model:
    """A factory: what it is called, the tasks it can do, features it needs finite (by place), and how it fits."""

    name: str
    tasks: tuple[str, ...]
    fit: Callable[..., Fitted]
    finite: tuple[int, ...] = ()
    defaults: dict = field(default_factory=dict)


MODELS: dict[str, Model] = {}


def register_model(name: str, tasks: Sequence[str], finite: Sequence[int] = (), **defaults):
    """Register fit(train, features, task, **parameters) -> Fitted under a name, with its parameters' defaults."""
    if name in MODELS:
        raise ValueError(f"model {name} exists")
    if not tasks or set(tasks) - set(TASKS):
        raise ValueError(f"tasks are of {TASKS}")

    def add(fit):
        MODELS[name] = Model(name, tuple(tasks), fit, tuple(finite), defaults)
        return fit

    return add


def model_parameters(name: str, given: dict | None = None) -> dict:
    """The model's parameters: defaults, replaced by given ones; unknown names and values of another kind are refused."""
    if name not in MODELS:
        raise ValueError(f"no model {name}; there are {sorted(MODELS)}")
    out = dict(MODELS[name].defaults)
    for k, v in (given or {}).items():
        if k not in out:
            raise ValueError(f"{name} has no parameter {k}; it has {sorted(out)}")
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < 0:
            raise ValueError(f"{k} must be a finite number, not below 0")
        if isinstance(out[k], int) and (not isinstance(v, int) or v < 1):
            raise ValueError(f"{k} must be a positive whole number")
        out[k] = v
    return out


def normalised(weights: Sequence[float], features: list[str]) -> dict[str, float]:
    total = float(sum(weights))
    return {f: float(w) / total if total > 0 else 0.0 for f, w in zip(features, weights, strict=True)}


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing and infinite features become FILL."""
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(FILL)) for c in features})


# ---- passthrough


@register_model("factor_passthrough", ("regression",), finite=(-1,))
def _passthrough(train: DataFrame, features: list[str], task: str) -> Fitted:
    """The last feature is the score."""
    return Fitted(lambda df: df.withColumn("score", F.col(features[-1]).cast("double")), {f: float(f == features[-1]) for f in features})


def passthrough(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("score", finite(F.col(features[-1]))).filter("score IS NOT NULL")


# ---- classification tree: levels of histograms


@dataclass
class _Split:
    feature: str
    threshold: float
    left: _Split | float
    right: _Split | float


def _tree_column(node: _Split | float) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    return F.when(F.col(node.feature) <= node.threshold, _tree_column(node.left)).otherwise(_tree_column(node.right))


def _gini(positive: float, n: float) -> float:
    p = positive / n
    return 2 * p * (1 - p)


def _long(train: DataFrame, features: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).alias("v")) for k, f in enumerate(features)])).alias("x")
    return train.select("__node", "label", pairs).select("__node", "label", "x.k", "x.v")


def fit_tree(train: DataFrame, features: list[str], max_depth: int = 3, min_samples_leaf: int = 20, max_thresholds: int = 32) -> tuple[_Split | float,
    dict[str, float]]:
    """A binary classification tree on label 0/1 by Gini gain, and its gain-weighted importances.

    A feature with more than max_thresholds values in a node is cut at that many inner quantiles, else between its
    values. Each level takes two aggregations over all rows: thresholds per node, then counts between them; the driver sees
    nodes x features x thresholds numbers. Of equal gains the first feature and least threshold count.
    """
    weights = dict.fromkeys(features, 0.0)
    nodes: dict[int, tuple[float, float]] = {}
    splits: dict[int, tuple[str, float]] = {}
    total = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total[0]:
        raise ValueError("no training rows")
    nodes[1] = (float(total[0]), float(total[1]))
    place = F.lit(1)
    quantiles = [(i + 1) / (max_thresholds + 1) for i in range(max_thresholds)]
    open_nodes = [1]
    for _ in range(max_depth):
        able = [i for i in open_nodes if nodes[i][0] >= 2 * min_samples_leaf and 0 < nodes[i][1] < nodes[i][0]]
        if not able:
            break
        rows = _long(train.withColumn("__node", place).filter(F.col("__node").isin(able)), features)
        values = rows.groupBy("__node", "k").agg(F.countDistinct("v").alias("n"), F.percentile("v", F.array(*map(F.lit, quantiles))).alias("q")).collect()
        few = [(r["__node"], r.k) for r in values if 2 <= r.n <= max_thresholds]
        inner: dict[tuple[int, int], list[float]] = {(r["__node"], r.k): sorted(set(r.q)) for r in values if r.n > max_thresholds}
        if few:
            wanted = F.lit(False)
            for i, k in few:
                wanted |= (F.col("__node") == i) & (F.col("k") == k)
            for r in rows.filter(wanted).groupBy("__node", "k").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():
                inner[r["__node"], r.k] = [(a + b) / 2 for a, b in zip(r.v, r.v[1:], strict=False)]
        if not inner:
            break
        cuts = F.create_map(*[x for (i, k), t in inner.items() for x in (F.lit(f"{i}:{k}"), F.array(*map(F.lit, t)))])
        key = F.concat_ws(":", "__node", "k")
        below = F.size(F.filter(F.try_element_at(cuts, key), lambda t: t < F.col("v")))
        counted = rows.withColumn("cell", below).filter("cell >= 0").groupBy("__node", "k", "cell").agg(F.count(F.lit(1)).alias("n"),
            F.sum("label").alias("p")).collect()
        cells: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        for r in counted:
            cells.setdefault((r["__node"], r.k), {})[r.cell] = (float(r.n), float(r.p))
        open_nodes = []
        for i in able:
            n, p = nodes[i]
            best: tuple[float, int, float, float, float] | None = None
            for k in range(len(features)):
                left_n = left_p = 0.0
                for c, t in enumerate(inner.get((i, k), [])):
                    dn, dp = cells.get((i, k), {}).get(c, (0.0, 0.0))
                    left_n, left_p = left_n + dn, left_p + dp
                    if min(left_n, n - left_n) < min_samples_leaf:
                        continue
                    gain = _gini(p, n) - (left_n * _gini(left_p, left_n) + (n - left_n) * _gini(p - left_p, n - left_n)) / n
                    if best is None or gain > best[0]:
                        best = (gain, k, t, left_n, left_p)
            if best is None or best[0] <= 0:
                continue
            gain, k, t, left_n, left_p = best
            splits[i] = (features[k], float(t))
            weights[features[k]] += gain * n
            nodes[2 * i], nodes[2 * i + 1] = (left_n, left_p), (n - left_n, p - left_p)
            open_nodes += [2 * i, 2 * i + 1]
        place_of = place
        for i, (f, t) in splits.items():
            if 2 * i in open_nodes:
                place_of = F.when(place == i, F.when(F.col(f) <= t, 2 * i).otherwise(2 * i + 1)).otherwise(place_of)
        place = place_of

    def built(i: int) -> _Split | float:
        if i not in splits:
            return nodes[i][1] / nodes[i][0]
        return _Split(*splits[i], built(2 * i), built(2 * i + 1))

    return built(1), normalised(list(weights.values()), features)


@register_model("simple_decision_tree", ("classification",), max_depth=3, min_samples_leaf=20, max_thresholds=32)
def _tree(train: DataFrame, features: list[str], task: str, **parameters) -> Fitted:
    tree, weights = fit_tree(train, features, **parameters)
    return Fitted(lambda df: df.withColumn("score", _tree_column(tree)), weights)


# ---- linear models and boosting


def _constant(train: DataFrame, target: str) -> float | None:
    low, high = train.agg(F.min(target), F.max(target)).first()
    return None if low != high else float(low)


def _scored(fitted, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    def score(df: DataFrame) -> DataFrame:
        out = fitted.transform(df)
        value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.withColumn("score", value).select(*[F.col(f"`{c}`") for c in df.columns], "score")

    return score


def _flat(value: float, features: list[str]) -> Fitted:
    return Fitted(lambda df: df.withColumn("score", F.lit(value)), dict.fromkeys(features, 0.0))


@register_model("logistic_regression", ("classification", "regression"), c=1.0, alpha=1.0, max_iter=1000, tol=1e-4)
def _linear(train: DataFrame, features: list[str], task: str, c: float, alpha: float, max_iter: int, tol: float) -> Fitted:
    """Standardised, L2: a logistic regression of the label or a ridge regression of the return; one class or value only is a constant."""
    if task == "regression":
        return fit_ridge(train, features, alpha)
    if (value := _constant(train, "label")) is not None:
        return _flat(value, features)
    n = train.count()
    logistic = LogisticRegression(featuresCol="__x", labelCol="label", regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter, tol=tol,
        standardization=False)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), logistic]).fit(train)
    scale = fitted.stages[1].std.toArray()
    return Fitted(_scored(fitted, features),
        normalised(np.abs(np.divide(fitted.stages[2].coefficients.toArray(), scale, out=np.zeros_like(scale), where=scale > 0)), features))


def _boosting(classifier, regressor):
    def fit(train: DataFrame, features: list[str], task: str, n_estimators: int, learning_rate: float, max_depth: int, min_child_samples: int,
        subsample: float, seed: int) -> Fitted:
        target = "label" if task == "classification" else "target_return"
        if (value := _constant(train, target)) is not None:
            return _flat(value, features)
        kind = classifier if task == "classification" else regressor
        model = kind(featuresCol="__x", labelCol=target, maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth,
            minInstancesPerNode=min_child_samples, subsamplingRate=subsample, seed=seed)
        fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), model]).fit(train)
        return Fitted(_scored(fitted, features), normalised(fitted.stages[1].featureImportances.toArray(), features))

    return fit


register_model("gradient_boosting_tree", ("classification",), n_estimators=100, learning_rate=0.1, max_depth=3, min_child_samples=20, subsample=1.0,
    seed=42)(_boosting(GBTClassifier, GBTRegressor))
#: Spark's gradient boosting with the settings of the light library's regressor and classifier; it grows by level and has no dropout of trees.
register_model("lightgbm", ("classification", "regression"), n_estimators=300, learning_rate=0.03, max_depth=5, min_child_samples=50, subsample=0.8,
    seed=42)(_boosting(GBTClassifier, GBTRegressor))


# ---- ridge from moments


def _moments(data: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """n, sums of features, of their products, of their products with the target, and of the target, as one array per key."""
    x = [F.col(f).cast("double") for f in features]
    y = F.col("target_return").cast("double")
    parts = [F.count(F.lit(1)).cast("double"), F.sum(y), *[F.sum(a) for a in x], *[F.sum(a * y) for a in x],
        *[F.sum(a * b) for i, a in enumerate(x) for b in x[i:]]]
    return data.groupBy(*keys).agg(F.min("target_return").alias("lo"), F.max("target_return").alias("hi"), F.max("target_end_date").alias("last_end"),
        *[p.alias(f"m{k}") for k, p in enumerate(parts)])


def solve_ridge(moments: np.ndarray, k: int, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients of raw features) of a standardised ridge regression from one row of moments."""
    n, sy, sx, sxy = moments[0], moments[1], moments[2 : 2 + k], moments[2 + k : 2 + 2 * k]
    products = np.zeros((k, k))
    products[np.triu_indices(k)] = moments[2 + 2 * k :]
    products = products + products.T - np.diag(np.diag(products))
    mean = sx / n
    covariance = products / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    scale[scale <= 1e-12 * np.maximum(np.abs(mean), 1)] = 1.0
    z = n * covariance / np.outer(scale, scale)
    weights = np.linalg.solve(z + alpha * np.eye(k), (sxy - mean * sy) / scale) if alpha > 0 else np.linalg.lstsq(z, (sxy - mean * sy) / scale, rcond=None)[0]
    weights = weights / scale
    return float(sy / n - mean @ weights), weights


def _linear_score(intercept, weights, features: list[str]) -> Column:
    out = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    for w, f in zip(weights, features, strict=True):
        out = out + (w if isinstance(w, Column) else F.lit(float(w))) * F.col(f).cast("double")
    return out


def fit_ridge(train: DataFrame, features: list[str], alpha: float = 1.0) -> Fitted:
    row = _moments(train, features).first()
    if row is None or not row.m0:
        raise ValueError("no training rows")
    if row.lo == row.hi:
        return _flat(float(row.lo), features)
    intercept, weights = solve_ridge(np.array([row[f"m{k}"] for k in range(len(row) - 3)]), len(features), alpha)
    return Fitted(lambda df: df.withColumn("score", _linear_score(intercept, weights, features)), normalised(np.abs(weights), features))


def walk_forward_ridge(dataset: DataFrame, features: list[str], validation_start, alpha: float = 1.0) -> DataFrame:
    """Every date from validation_start on, predicted by the ridge regression of all samples that ended before it.

    Moments are summed per end date and then along dates, so all fits take one pass over the data; the running sums are a row per date.
    """
    ship(dataset.sparkSession)
    data = filled(dataset, features)
    daily = _moments(data, features, "target_end_date").withColumnRenamed("target_end_date", "at")
    size = 2 + 2 * len(features) + len(features) * (len(features) + 1) // 2
    dates = data.filter(F.col("target_date") >= F.lit(validation_start).cast("date")).select(F.col("target_date").alias("at")).distinct().withColumn(
        "asked", F.lit(True))
    both = daily.withColumn("asked", F.lit(False)).unionByName(dates, allowMissingColumns=True)
    both = both.withColumn("day", F.unix_date("at"))
    before = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    running = both.select("at", "asked", F.max("last_end").over(before).alias("training_end_date"),
        F.array(*[F.sum(f"m{k}").over(before) for k in range(size)]).alias("m")).filter("asked AND m[0] > 0")

    def solve(batches):
        for batch in batches:
            found = [solve_ridge(np.array(m), len(features), alpha) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([int(m[0]) for m in batch.column(2).to_pylist()], pa.int64()),
                pa.array([[a, *w] for a, w in found], pa.list_(pa.float64()))],
                ["target_date", "training_end_date", "training_samples", "w"],
            )

    fits = running.select("at", "training_end_date", "m").mapInArrow(solve, "target_date date, training_end_date date, training_samples long, w array<double>")
    score = _linear_score(F.col("w")[0], [F.col("w")[k + 1] for k in range(len(features))], features)
    return data.join(fits, "target_date").withColumn("score", score).drop("w")


# ---- experiments


def label_mismatches(dataset: DataFrame, threshold: float = 0.005) -> DataFrame:
    """One row: rows, rows without a finite target, rows whose label is missing, not 0/1 or not that of the threshold."""
    target = finite(F.col("target_return"))
    wrong = F.col("label").isNull() | (F.col("label") != direction_label(F.col("target_return"), threshold).cast("int"))
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    return dataset.agg(F.count(F.lit(1)).alias("rows"), count(target.isNull()).alias("invalid_targets"), count(wrong).alias("mismatched_labels"))


def check_labels(dataset: DataFrame, threshold: float = 0.005) -> DataFrame:
    row = label_mismatches(dataset, threshold).first()
    if row.invalid_targets:
        raise ValueError(f"{row.invalid_targets} rows without a finite target_return")
    if row.mismatched_labels:
        raise ValueError(f"{row.mismatched_labels} labels differ from the threshold {threshold}")
    return dataset


def split_by_date(dataset: DataFrame, validation_start) -> tuple[DataFrame, DataFrame]:
    """(before, from then on) by target_date; neither may be empty."""
    at = F.lit(validation_start).cast("date")
    train, validation = dataset.filter(F.col("target_date") < at), dataset.filter(F.col("target_date") >= at)
    for part, where in ((train, "before"), (validation, "from")):
        if not part.limit(1).count():
            raise ValueError(f"no samples {where} {validation_start}")
    return train, validation


def finite_features(dataset: DataFrame, features: list[str], places: Sequence[int]) -> DataFrame:
    """Rows whose features at those places (negative from the end) are finite."""
    for k in places:
        if not -len(features) <= k < len(features):
            raise ValueError(f"no feature at place {k} of {len(features)}")
        dataset = dataset.filter(finite(F.col(features[k])).isNotNull())
    return dataset


@dataclass
class Experiment:
    """Fit and predict: "single" on samples that end before validation_start, "rolling" anew for each date."""

    features: list[str]
    model: str = "simple_decision_tree"
    task: str = "classification"
    validation_start: object = None
    mode: str = "rolling"
    threshold: float = 0.005
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"no model {self.model}")
        if self.task not in MODELS[self.model].tasks:
            raise ValueError(f"{self.model} does not do {self.task}")
        if self.mode not in ("rolling", "single"):
            raise ValueError("mode is rolling or single")
        self.parameters = model_parameters(self.model, self.parameters)

    def _fit(self, train: DataFrame) -> tuple[Fitted, int, object]:
        n, last = train.agg(F.count(F.lit(1)), F.max("target_end_date")).first()
        if not n:
            raise ValueError("no training samples are left")
        return MODELS[self.model].fit(train, self.features, self.task, **self.parameters), n, last

    def _predict(self, fitted: Fitted, n: int, last, rows: DataFrame) -> DataFrame:
        out = fitted.score(rows).withColumn("training_samples", F.lit(n)).withColumn("training_end_date", F.lit(last))
        hit = (F.col("score") >= 0.5).cast("int") if self.task == "classification" else direction_label(F.col("score"), self.threshold).cast("int")
        return out.withColumn("prediction", hit)

    def run(self, dataset: DataFrame) -> tuple[DataFrame, dict[str, float] | None]:
        """(predictions with score and prediction, importances averaged over fits)."""
        data = finite_features(check_labels(dataset, self.threshold), self.features, MODELS[self.model].finite)
        if self.mode == "rolling" and self.model == "logistic_regression" and self.task == "regression":
            out = walk_forward_ridge(data, self.features, self.validation_start, self.parameters["alpha"])
            return out.withColumn("prediction", direction_label(F.col("score"), self.threshold).cast("int")), None
        data = filled(data, self.features)
        usable = data.filter("eligible") if "eligible" in data.columns else data
        _, validation = split_by_date(data, self.validation_start)
        if self.mode == "single":
            fitted, n, last = self._fit(usable.filter(F.col("target_end_date") < F.lit(self.validation_start).cast("date")))
            return self._predict(fitted, n, last, validation), fitted.importances
        dates = [r[0] for r in validation.select("target_date").distinct().orderBy("target_date").collect()]  # one row per day
        out, weights = None, []
        for day in dates:
            at = F.lit(day).cast("date")
            fitted, n, last = self._fit(usable.filter(F.col("target_end_date") < at))
            one = self._predict(fitted, n, last, data.filter(F.col("target_date") == at))
            out = one if out is None else out.unionByName(one)
            weights.append(fitted.importances)
        mean = None if weights[0] is None else normalised([sum(w[f] for w in weights) / len(weights) for f in self.features], self.features)
        return out, mean
