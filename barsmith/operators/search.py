"""Expression search: grids and a seeded genetic loop over a stored context, scored in wide batches.

Selection dates choose; holdout dates are only ever scored for the frozen best. The driver holds expressions and a
row of metrics per candidate; values stay in Spark.
"""

from __future__ import annotations

import itertools
import math
import random
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.dsl import average_rank
from ..functions.scalars import finite, ratio
from ..scratch import shared_dir
from .research import correlation, forward_targets

BATCH = 24
c = F.col


# ---- context


@dataclass(frozen=True)
class Context:
    """Daily features with targets, and the dates that select and those held out."""

    frame: DataFrame
    holdout_start: object
    selection_start: object = None
    holdout_end: object = None
    fixed_features: tuple[str, ...] = ()

    def period(self, name: str) -> DataFrame:
        date, cut = c("target_date"), F.lit(self.holdout_start).cast("date")
        if name == "selection":
            out = self.frame.filter(date < cut)
            return out if self.selection_start is None else out.filter(date >= F.lit(self.selection_start).cast("date"))
        out = self.frame.filter(date >= cut)
        return out if self.holdout_end is None else out.filter(date <= F.lit(self.holdout_end).cast("date"))


def make_context(daily: DataFrame, holdout_start, target: str = "inday", store: bool = True, **dates) -> Context:
    """Targets are attached once and, unless store is false, written to the shared folder, so that no batch computes daily again."""
    frame = forward_targets(daily, target)
    if store:
        path = f"{shared_dir(daily.sparkSession)}/barsmith/context-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        frame = daily.sparkSession.read.parquet(path)
    return Context(frame, holdout_start, **dates)


# ---- candidates


@dataclass(frozen=True)
class Stage:
    """Alternatives applied to each expression so far: (operator, {parameter: values}); None keeps it."""

    choices: tuple[tuple[str, dict] | None, ...]

    def expand(self, nodes: list[dsl.Node]) -> list[dsl.Node]:
        out = []
        for n, choice in itertools.product(nodes, self.choices):
            if choice is None:
                out.append(n)
            else:
                names = list(choice[1])
                out += [dsl.call(choice[0], n, **dict(zip(names, v, strict=True))) for v in itertools.product(*(choice[1][k] for k in names))]
        return out

    @property
    def width(self) -> int:
        return sum(1 if x is None else math.prod(len(v) for v in x[1].values()) for x in self.choices)


def distinct(nodes: list[dsl.Node]) -> list[dsl.Node]:
    """Nodes of different canonical text, in order; two texts of one id are an error."""
    out: dict[str, dsl.Node] = {}
    for n in nodes:
        if out.setdefault(n.identity, n).canonical != n.canonical:
            raise ValueError(f"two expressions have the id {n.identity}")
    return list(out.values())


def grid(bases: list[dsl.Node | str], stages: list[Stage], limit: int = 10_000) -> list[dsl.Node]:
    """Distinct expressions of the staged product; ValueError if the product exceeds limit before expansion."""
    nodes = [dsl.parse(b) if isinstance(b, str) else b for b in bases]
    if len(nodes) * math.prod(s.width for s in stages) > limit:
        raise ValueError("grid too large")
    for s in stages:
        nodes = s.expand(nodes)
    return distinct(nodes)


def combined(*grids: list[dsl.Node]) -> list[dsl.Node]:
    return distinct([n for g in grids for n in g])


def binary_grid(operators: list[str], left: list[dsl.Node], right: list[dsl.Node], commutative: tuple[str, ...] = ("add", "multiply")) -> list[dsl.Node]:
    """Every operator over pairs of different nodes; one order of a commutative one."""
    out = []
    for name, a, b in itertools.product(operators, left, right):
        if a != b and not (name in commutative and b.canonical < a.canonical and a in right and b in left):
            out.append(dsl.call(name, a, b))
    return distinct(out)


# ---- scoring


def scores(context: Context, candidates: list[dsl.Node], period: str = "selection", batch: int = BATCH) -> DataFrame:
    """factor_id, target_date, rows, samples, ic, rank_ic of each candidate on a period's dates.

    Expressions see all rows (a window may reach back of the period); candidates go in batches of one wide
    projection, stacked to long rows and grouped once.
    """
    own = context.period(period).select("code", "trade_date").withColumn("__mine", F.lit(True))
    out = None
    for k in range(0, len(candidates), batch):
        part = {n.identity: n for n in candidates[k : k + batch]}
        wide = dsl.evaluate(context.frame, part).join(own, ["code", "trade_date"], "left_semi")
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("factor_id"), finite(c(i)).alias("s")) for i in part])).alias("x")
        long = wide.select("target_date", finite(c("target_return")).alias("t"), pairs).select("target_date", "t", "x.factor_id", "x.s")
        long = long.withColumns({"s": F.when(c("t").isNotNull(), c("s")), "t": F.when(c("s").isNotNull(), c("t"))})
        long = long.withColumn("rs", average_rank(c("s"), "factor_id", "target_date")).withColumn("rt", average_rank(c("t"), "factor_id", "target_date"))
        got = long.groupBy("factor_id", "target_date").agg(F.count(F.lit(1)).alias("rows"), F.count("s").alias("samples"),
            correlation(c("s"), c("t")).alias("ic"), correlation(c("rs"), c("rt")).alias("rank_ic"))
        out = got if out is None else out.unionByName(got)
    return out


def metrics(daily: DataFrame, least_samples: int = 2) -> DataFrame:
    """Per factor over a period: rows, valid values, coverage, mean IC and rank IC, their deviations, dates and ICIR; dates of fewer samples count
    as missing."""
    enough = c("samples") >= least_samples
    x = daily.withColumns({n: F.when(enough, c(n)) for n in ("ic", "rank_ic")})
    out = x.groupBy("factor_id").agg(
        F.sum("rows").alias("rows"), F.sum("samples").alias("valid"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"),
        F.stddev_samp("ic").alias("ic_std"), F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.count("rank_ic").alias("rank_ic_dates"),
    )
    return out.withColumns({"coverage": ratio(c("valid"), c("rows")), "rank_icir": ratio(c("rank_ic"), c("rank_ic_std"))})


def leaderboard(measured: DataFrame, min_coverage: float = 0.7, min_dates: int = 2) -> DataFrame:
    """Selection metrics turned so that the rank IC is not negative (direction), with eligibility."""
    direction = F.when(c("rank_ic") < 0, -1).otherwise(1)
    return measured.select(
        "factor_id", direction.alias("direction"), c("coverage").alias("selection_coverage"), c("rank_ic_dates").alias("selection_dates"),
        (c("ic") * direction).alias("selection_ic"), (c("rank_ic") * direction).alias("selection_rank_ic"),
        (c("rank_icir") * direction).alias("selection_rank_icir"), c("rank_ic_std").alias("selection_rank_ic_std"),
        F.coalesce(c("rank_ic").isNotNull() & (c("coverage") >= min_coverage) & (c("rank_ic_dates") >= min_dates), F.lit(False)).alias("eligible"),
    )


def top(board: DataFrame, k: int, objective: str = "selection_rank_ic") -> DataFrame:
    """The first k eligible rows by the objective, then id; holdout metrics may not choose."""
    if not objective.startswith("selection_"):
        raise ValueError("holdout metrics must not select")
    return board.filter("eligible").orderBy(c(objective).desc_nulls_last(), "factor_id").limit(k)


@dataclass
class Result:
    """Candidates by id, the leaderboard (a row per candidate), and what went wrong by id."""

    candidates: dict[str, dsl.Node]
    rows: list[dict]
    errors: dict[str, str] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)

    @property
    def best(self) -> dsl.Node:
        for r in self.rows:
            if r["eligible"]:
                return self.candidates[r["factor_id"]]
        raise ValueError("no eligible candidate")

    def candidate(self, factor_id: str) -> dsl.Node:
        if factor_id not in self.candidates:
            raise ValueError(f"no candidate {factor_id}")
        return self.candidates[factor_id]

    def row(self, factor_id: str) -> dict:
        return next(r for r in self.rows if r["factor_id"] == factor_id)

    def materialize(self, frame: DataFrame, factor_id: str | None = None, oriented: bool = False) -> DataFrame:
        """frame with the candidate's values (the best's by default) as a column of its id, turned by its direction on request."""
        node = self.best if factor_id is None else self.candidate(factor_id)
        if node.identity in frame.columns:
            raise ValueError(f"{node.identity} is a column already")
        out = dsl.evaluate(frame, {node.identity: node})
        sign = self.row(node.identity)["direction"] if oriented else 1
        return out.withColumn(node.identity, c(node.identity) * F.lit(float(sign)))


def _evaluated(score: Callable[[list[dsl.Node]], DataFrame], nodes: list[dsl.Node], errors: dict[str, str]) -> list[dict]:
    """Rows of score(nodes); where a batch fails, each node by itself, so that one bad candidate is an error and no more."""
    try:
        return [r.asDict() for r in score(nodes).collect()]  # one row per candidate
    except Exception as e:
        if len(nodes) == 1:
            errors[nodes[0].identity] = str(e)[:500]
            return []
        half = len(nodes) // 2
        return _evaluated(score, nodes[:half], errors) + _evaluated(score, nodes[half:], errors)


def _ranked(rows: list[dict], key: str) -> list[dict]:
    return sorted(rows, key=lambda r: (not r["eligible"], -r[key] if r[key] is not None and math.isfinite(r[key]) else math.inf, r["nodes"],
        r["depth"], r["factor_id"]))


def _with_shape(rows: list[dict], candidates: dict[str, dsl.Node]) -> list[dict]:
    return [r | {"expression": candidates[r["factor_id"]].canonical, "nodes": candidates[r["factor_id"]].node_count,
        "depth": candidates[r["factor_id"]].depth} for r in rows]


def _freeze(context: Context, result: Result, holdout_top_k: int, model_top_k: int, model: Callable[[dsl.Node, Context], dict] | None) -> Result:
    """Score the holdout, and then a model, for the first eligible rows only."""
    frozen = [r for r in result.rows if r["eligible"]]
    if holdout_top_k and frozen:
        nodes = [result.candidates[r["factor_id"]] for r in frozen[:holdout_top_k]]
        found = {r["factor_id"]: r for r in _evaluated(lambda n: metrics(scores(context, n, "holdout")), nodes, result.errors)}
        for r in frozen[:holdout_top_k]:
            if (h := found.get(r["factor_id"])) is not None:
                r |= {f"holdout_{k}": None if h[k] is None else h[k] * r["direction"] for k in ("ic", "rank_ic")} | {"holdout_dates": h["rank_ic_dates"]}
    for r in frozen[:model_top_k] if model else []:
        try:
            r |= {f"model_{k}": v for k, v in model(result.candidates[r["factor_id"]], context).items()}
        except Exception as e:
            result.errors[r["factor_id"]] = str(e)[:500]
    return result


def grid_search(context: Context, candidates: list[dsl.Node], objective: str = "selection_rank_ic", holdout_top_k: int = 1, model_top_k: int = 0,
    model=None, limit: int = 10_000, **eligibility) -> Result:
    """Screen on selection, then the holdout for the best holdout_top_k, then a model for the best model_top_k."""
    if not objective.startswith("selection_"):
        raise ValueError("holdout metrics must not select")
    if len(candidates) > limit:
        raise ValueError("too many candidates")
    by_id = {n.identity: n for n in distinct(candidates)}
    errors: dict[str, str] = {}
    rows = _evaluated(lambda nodes: leaderboard(metrics(scores(context, nodes)), **eligibility), list(by_id.values()), errors)
    return _freeze(context, Result(by_id, _ranked(_with_shape(rows, by_id), objective), errors), holdout_top_k, model_top_k, model)


def model_evaluator(model: str, task: str = "classification", mode: str = "single", **parameters) -> Callable[[dsl.Node, Context], dict]:
    """evaluate(node, context): an experiment on the fixed features and the candidate, from the holdout on; its metrics."""
    from . import models, research

    def evaluate(node: dsl.Node, context: Context) -> dict:
        features = [*context.fixed_features, node.identity]
        data = dsl.evaluate(context.frame, {node.identity: node}).withColumn("label", research.direction_label(c("target_return")).cast("int"))
        if context.holdout_end is not None:
            data = data.filter(c("target_date") <= F.lit(context.holdout_end).cast("date"))
        predicted, _ = models.Experiment(features, model, task, context.holdout_start, mode, parameters=parameters).run(data)
        row = (research.classification(predicted, "score", "label") if task == "classification" else research.regression(predicted, "score",
            "target_return")).first()
        return row.asDict()

    return evaluate


def daily_detail(context: Context, result: Result, k: int) -> DataFrame:
    """selection_rank, factor_id, period, target_date, samples, ic, rank_ic (turned) of the first k eligible candidates."""
    out = None
    for place, r in enumerate([r for r in result.rows if r["eligible"]][:k], 1):
        for period in ("selection", "holdout"):
            one = scores(context, [result.candidates[r["factor_id"]]], period)
            one = one.select(F.lit(place).alias("selection_rank"), "factor_id", F.lit(period).alias("period"), "target_date", "samples",
                *[(c(n) * r["direction"]).alias(n) for n in ("ic", "rank_ic")])
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no eligible candidate")
    return out


# ---- equal candidates


def fingerprints(context: Context, candidates: list[dsl.Node], digits: int = 9) -> DataFrame:
    """factor_id and, for either direction, order-free hashes of its values and of its daily ranks on selection: equal for equal factors."""
    own = context.period("selection").select("code", "trade_date")
    part = {n.identity: n for n in candidates}
    wide = dsl.evaluate(context.frame, part).join(own, ["code", "trade_date"], "left_semi").filter(finite(c("target_return")).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("factor_id"), finite(c(i)).alias("s")) for i in part])).alias("x")
    long = wide.select("code", "trade_date", "target_date", pairs).select("code", "trade_date", "target_date", "x.factor_id", "x.s")
    day = average_rank(c("s"), "factor_id", "target_date")
    long = long.withColumn("r", day).withColumn("n", F.count("s").over(dsl.Window.partitionBy("factor_id", "target_date")))
    rounded = lambda x: F.round(x, digits) + 0.0
    digest = lambda x: F.concat_ws("-", F.bit_xor(F.xxhash64("code", "trade_date", x)), F.bit_xor(F.xxhash64("trade_date", x, "code")))
    return long.groupBy("factor_id").agg(
        digest(rounded(c("s"))).alias("value_up"), digest(rounded(-c("s"))).alias("value_down"), digest(c("r")).alias("rank_up"),
        digest(c("n") + 1 - c("r")).alias("rank_down"),
    )


def without_equals(rows: list[dict]) -> list[dict]:
    """Rows (factor_id, nodes, depth, eligible, fitness, value_key, rank_key) of which no two have equal values or ranks: the simplest stays."""
    simplest = sorted(rows, key=lambda r: (r["nodes"], r["depth"], not r["eligible"], -(r["fitness"] if r["fitness"] is not None else -math.inf),
        r["factor_id"]))
    values, ranks, out = set(), set(), []
    for r in simplest:
        if r["value_key"] in values or r["rank_key"] in ranks:
            continue
        out.append(r)
        values.add(r["value_key"])
        ranks.add(r["rank_key"])
    return out


# ---- genetic search


_WINDOWS, _PERIODS = (5, 10, 20, 60), (1, 2, 5, 10, 20)


def _operators() -> dict[str, dict[str, tuple]]:
    plain = {n: {} for n in ("add", "subtract", "multiply", "divide", "absolute", "negative", "cs_rank", "cs_zscore")}
    return plain | {n: {"periods": _PERIODS} for n in ("delta", "returns")} | {n: {"window": _WINDOWS} for n in ("ts_mean", "ts_stddev", "ts_rank",
        "ts_correlation")}


@dataclass(frozen=True)
class GeneticConfig:
    """Sizes, limits, fitness weights and probabilities of a genetic search."""

    sources: tuple[str, ...] = ("close", "volume", "return_1d")
    operators: dict[str, dict[str, tuple]] = field(default_factory=_operators)
    commutative: frozenset[str] = frozenset({"add", "multiply", "ts_correlation"})
    different_inputs: frozenset[str] = frozenset({"ts_correlation"})
    population: int = 300
    generations: int = 20
    max_evaluations: int = 5000
    initial_max_depth: int = 3
    max_depth: int = 5
    max_nodes: int = 15
    max_lookback: int = 120
    min_coverage: float = 0.7
    target_coverage: float = 0.9
    objective: str = "selection_rank_ic"
    stability_weight: float = 0.5
    free_nodes: int = 3
    length_penalty: float = 0.0005
    free_depth: int = 2
    depth_penalty: float = 0.0005
    coverage_penalty: float = 0.02
    elite_ratio: float = 0.1
    tournament: int = 5
    crossover: float = 0.35
    subtree_mutation: float = 0.3
    parameter_mutation: float = 0.2
    reproduction: float = 0.15
    terminal: float = 0.25
    patience: int = 5
    min_improvement: float = 0.0001
    seed: int = 20260809

    def __post_init__(self):
        if not self.sources or len(set(self.sources)) != len(self.sources):
            raise ValueError("sources are different column names, at least one")
        for n in ("population", "generations", "max_evaluations", "max_depth", "max_nodes", "tournament", "patience"):
            if isinstance(getattr(self, n), bool) or not isinstance(getattr(self, n), int) or getattr(self, n) < 1:
                raise ValueError(f"{n} must be a positive whole number")
        if not 0 <= self.initial_max_depth <= self.max_depth:
            raise ValueError("initial_max_depth is between 0 and max_depth")
        if not 0 <= self.min_coverage <= self.target_coverage <= 1 or not 0 <= self.elite_ratio <= 1 or not 0 <= self.terminal <= 1:
            raise ValueError("shares are in [0, 1], min_coverage not above target_coverage")
        chances = (self.crossover, self.subtree_mutation, self.parameter_mutation, self.reproduction)
        if min(chances) < 0 or not math.isclose(sum(chances), 1.0, abs_tol=1e-12):
            raise ValueError("the four chances sum to 1")
        if not self.objective.startswith("selection_"):
            raise ValueError("holdout metrics must not select")
        if unknown := set(self.operators) - set(dsl.OPERATORS):
            raise ValueError(f"unknown operators {sorted(unknown)}")


class Generator:
    """Seeded trees over a configuration's sources and operators."""

    def __init__(self, config: GeneticConfig):
        self.config, self.random = config, random.Random(config.seed)

    def valid(self, n: dsl.Node) -> bool:
        k = self.config
        return bool(n.columns) and n.depth - 1 <= k.max_depth and n.node_count <= k.max_nodes and n.lookback <= k.max_lookback

    def called(self, name: str, *inputs: dsl.Node) -> dsl.Node | None:
        """A call with drawn parameters, inputs of a commutative operator in one order; None where inputs must differ and do not."""
        if name in self.config.different_inputs and len(set(inputs)) < len(inputs):
            return None
        if name in self.config.commutative:
            inputs = tuple(sorted(inputs, key=lambda n: n.canonical))
        drawn = {k: self.random.choice(v) for k, v in self.config.operators[name].items()}
        return dsl.call(name, *inputs, **drawn)

    def source(self) -> dsl.Node:
        return dsl.column(self.random.choice(self.config.sources))

    def grow(self, depth: int, root: str | None = None) -> dsl.Node:
        if depth <= 0 or root is None and self.random.random() < self.config.terminal:
            return self.source()
        for _ in range(20):
            name = root or self.random.choice(list(self.config.operators))
            n = self.called(name, *(self.grow(depth - 1) for _ in range(dsl.OPERATORS[name].arity)))
            if n is not None:
                return n
        return self.source()

    def subtrees(self, n: dsl.Node) -> list[dsl.Node]:
        return [n] + [x for i in n.inputs for x in self.subtrees(i)]

    def replaced(self, n: dsl.Node, old: dsl.Node, new: dsl.Node) -> dsl.Node:
        if n == old:
            return new
        inputs = tuple(self.replaced(x, old, new) for x in n.inputs)
        if n.operator in self.config.commutative:
            inputs = tuple(sorted(inputs, key=lambda x: x.canonical))
        return dsl.Node(n.operator, inputs, n.parameters)

    def crossover(self, a: dsl.Node, b: dsl.Node) -> dsl.Node:
        return self.replaced(a, self.random.choice(self.subtrees(a)), self.random.choice(self.subtrees(b)))

    def subtree_mutation(self, a: dsl.Node) -> dsl.Node:
        return self.replaced(a, self.random.choice(self.subtrees(a)), self.grow(self.random.randint(0, 2)))

    def parameter_mutation(self, a: dsl.Node) -> dsl.Node:
        with_parameters = [n for n in self.subtrees(a) if self.config.operators.get(n.operator)]
        if not with_parameters:
            return a
        old = self.random.choice(with_parameters)
        return self.replaced(a, old, self.called(old.operator, *old.inputs) or old)

    def child(self, parents: list[dsl.Node]) -> tuple[dsl.Node, str]:
        a, draw, k = self.tournament(parents), self.random.random(), self.config
        if draw < k.crossover:
            return self.crossover(a, self.tournament(parents)), "crossover"
        if draw < k.crossover + k.subtree_mutation:
            return self.subtree_mutation(a), "subtree_mutation"
        if draw < k.crossover + k.subtree_mutation + k.parameter_mutation:
            return self.parameter_mutation(a), "parameter_mutation"
        return a, "reproduction"

    def tournament(self, ranked: list[dsl.Node]) -> dsl.Node:
        """The best placed of a few drawn without replacement (ranked: best first)."""
        return ranked[min(self.random.sample(range(len(ranked)), min(self.config.tournament, len(ranked))))]

    def filled(self, chosen: dict[str, tuple[dsl.Node, str]], make: Callable[[], tuple[dsl.Node, str]], tries: int) -> None:
        for _ in range(tries):
            if len(chosen) >= self.config.population:
                return
            n, how = make()
            if self.valid(n):
                chosen.setdefault(n.identity, (n, how))

    def first(self) -> dict[str, tuple[dsl.Node, str]]:
        out: dict[str, tuple[dsl.Node, str]] = {}
        self.cover(out)
        self.filled(out, lambda: (self.grow(self.random.randint(0, self.config.initial_max_depth)), "initial"), 100 * self.config.population)
        return out

    def cover(self, chosen: dict[str, tuple[dsl.Node, str]]) -> None:
        """Add a tree for each source and operator that none of the chosen has, as far as there is room."""
        columns = set().union(*(n.columns for n, _ in chosen.values())) if chosen else set()
        used = {x.operator for n, _ in chosen.values() for x in self.subtrees(n)}
        wanted = [lambda s=s: dsl.column(s) for s in self.config.sources if s not in columns] + [lambda o=o: self.grow(1, o)
            for o in self.config.operators if o not in used]
        self.random.shuffle(wanted)
        for make in wanted:
            n = make()
            if len(chosen) < self.config.population and self.valid(n):
                chosen.setdefault(n.identity, (n, "coverage"))

    def next(self, ranked: list[dsl.Node]) -> dict[str, tuple[dsl.Node, str]]:
        """Elites, trees for what is missing, children, then immigrants."""
        out = {n.identity: (n, "elite") for n in ranked[: max(1, math.ceil(len(ranked) * self.config.elite_ratio))]}
        self.cover(out)
        self.filled(out, lambda: self.child(ranked), 100 * self.config.population)
        self.filled(out, lambda: (self.grow(self.random.randint(1, self.config.max_depth)), "immigrant"), 100 * self.config.population)
        return out


def fitness(row: dict, config: GeneticConfig) -> float | None:
    """The objective less half a standard error of the rank IC and penalties of length, depth and missing coverage; None if not eligible."""
    value, spread, dates, coverage = row[config.objective], row["selection_rank_ic_std"], row["selection_dates"], row["selection_coverage"]
    if value is None or coverage is None or coverage < config.min_coverage:
        return None
    error = 0.0
    if config.stability_weight:
        if spread is None or not dates:
            return None
        error = spread / math.sqrt(dates)
    return (
        value - config.stability_weight * error - config.length_penalty * max(0, row["nodes"] - config.free_nodes) - config.depth_penalty * max(0,
        row["depth"] - 1 - config.free_depth)
        - config.coverage_penalty * max(0.0, config.target_coverage - coverage)
    )


def genetic_search(context: Context, config: GeneticConfig = GeneticConfig(), holdout_top_k: int = 1, model_top_k: int = 0, model=None,
    progress: Callable[[dict], None] | None = None) -> Result:
    """Evolve expressions by their selection fitness; each generation is one scoring and one fingerprint job, memoised by id.

    Equal candidates (by values or daily ranks) count once, the simplest. It ends after the generations, the evaluations, or `patience` generations
    without progress.
    """
    if missing := set(config.sources) - set(context.frame.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    g = Generator(config)
    people = g.first()
    seen: dict[str, dict] = {}
    candidates: dict[str, dsl.Node] = {}
    errors: dict[str, str] = {}
    history: list[dict] = []
    best, stale = -math.inf, 0
    for generation in range(config.generations):
        fresh = [n for i, (n, _) in people.items() if i not in seen and i not in errors][: max(0, config.max_evaluations - len(seen))]
        if fresh:
            candidates |= {n.identity: n for n in fresh}
            rows = _with_shape(_evaluated(lambda nodes: leaderboard(metrics(scores(context, nodes)), config.min_coverage), fresh, errors), candidates)
            prints = {r["factor_id"]: r for r in _evaluated(lambda nodes: fingerprints(context, nodes), [n for n in fresh if n.identity not in errors], errors)}
            for r in rows:
                p, side = prints.get(r["factor_id"], {}), "up" if r["direction"] > 0 else "down"
                value = fitness(r, config)
                seen[r["factor_id"]] = r | {"fitness": value, "eligible": value is not None, "origin": people[r["factor_id"]][1],
                    "generation": generation, "value_key": p.get(f"value_{side}", r["factor_id"]), "rank_key": p.get(f"rank_{side}", r["factor_id"])}
        ranked = _ranked(without_equals([seen[i] for i in people if i in seen]), "fitness")
        able = [candidates[r["factor_id"]] for r in ranked if r["eligible"]]
        now = ranked[0]["fitness"] if able else -math.inf
        history.append({"generation": generation, "population": len(people), "new": len(fresh), "evaluations": len(seen), "eligible": len(able), "best": now})
        if progress:
            progress(history[-1])
        stale = 0 if now > best + config.min_improvement else stale + 1
        best = max(best, now)
        if not able or len(seen) >= config.max_evaluations or stale >= config.patience:
            break
        people = g.next(able)
    result = Result(candidates, _ranked(without_equals(list(seen.values())), "fitness"), errors, history)
    return _freeze(context, result, holdout_top_k, model_top_k, model)
