"""Factor expressions: a small causal language compiled to staged Spark columns.

An expression is a tree of Node(operator, inputs, parameters). Equal subtrees are
computed once. A tree is cut into levels at time-series and cross-section operators;
each level is one projection, so all windows over the same partitioning and order in it share a sort, and
element-wise steps are fused into the level that needs them. Missing is NULL; NaN and
infinities are folded into it. Comparisons with a missing side are false.
"""

from __future__ import annotations

import ast
import hashlib
import json
import keyword
import math
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import finite, ratio

KEYS = ("code", "trade_date")
MAX_SOURCE = 20_000


@dataclass(frozen=True)
class Node:
    operator: str
    inputs: tuple[Node, ...] = ()
    parameters: tuple[tuple[str, object], ...] = ()

    def param(self, name: str):
        return dict(self.parameters)[name]

    @property
    def canonical(self) -> str:
        parts = [x.canonical for x in self.inputs] + [f"{k}={v!r}" for k, v in self.parameters]
        if self.operator == "column":
            name = str(self.param("name"))
            return name if name.isidentifier() and not keyword.iskeyword(name) and unicodedata.normalize("NFKC", name) == name else f"column({name!r})"
        return f"{self.operator}({', '.join(parts)})"

    @property
    def identity(self) -> str:
        return "fg_" + hashlib.sha256(self.canonical.encode()).hexdigest()[:16]

    @property
    def depth(self) -> int:
        return 1 + max((x.depth for x in self.inputs), default=0)

    @property
    def node_count(self) -> int:
        return 1 + sum(x.node_count for x in self.inputs)

    @property
    def lookback(self) -> int:
        own = OPERATORS[self.operator].lookback(dict(self.parameters)) if self.operator in OPERATORS else 0
        return own + max((x.lookback for x in self.inputs), default=0)

    @property
    def columns(self) -> set[str]:
        own = {self.param("name")} if self.operator == "column" else set()
        return own.union(*(x.columns for x in self.inputs)) if self.inputs else own

    def to_dict(self) -> dict:
        return {"operator": self.operator, "inputs": [x.to_dict() for x in self.inputs], "parameters": dict(self.parameters)}

    @classmethod
    def from_dict(cls, x: dict) -> Node:
        return call(x["operator"], *map(cls.from_dict, x["inputs"]), **x["parameters"])

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Node:
        """The tree of to_json(), each node validated anew."""
        return cls.from_dict(json.loads(text))

    @property
    def causal(self) -> bool:
        """Whether no operator looks ahead (of those registered: none can be called that does)."""
        return all(x.causal for x in self.inputs) and (self.operator not in OPERATORS or OPERATORS[self.operator].lookback(dict(self.parameters)) >= 0)

    def __add__(self, o):
        return call("add", self, o)

    def __radd__(self, o):
        return call("add", o, self)

    def __sub__(self, o):
        return call("subtract", self, o)

    def __rsub__(self, o):
        return call("subtract", o, self)

    def __mul__(self, o):
        return call("multiply", self, o)

    def __rmul__(self, o):
        return call("multiply", o, self)

    def __truediv__(self, o):
        return call("divide", self, o)

    def __rtruediv__(self, o):
        return call("divide", o, self)

    def __neg__(self):
        return call("negative", self)

    def __abs__(self):
        return call("absolute", self)

    def __lt__(self, o):
        return call("less_than", self, o)

    def __le__(self, o):
        return call("less_equal", self, o)

    def __gt__(self, o):
        return call("greater_than", self, o)

    def __ge__(self, o):
        return call("greater_equal", self, o)

    def equal(self, o):
        return call("equal", self, o)

    def not_equal(self, o):
        return call("not_equal", self, o)


@dataclass
class Operator:
    arity: int
    scope: str  # element, time or cross
    build: Callable[..., Column]
    normalize: Callable[[dict], dict] = field(default=lambda p: _exact(p))
    lookback: Callable[[dict], int] = field(default=lambda p: 0)


OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, arity: int, scope: str = "element", normalize=None, lookback=None):
    """Register build(*columns, **parameters) -> Column; negative lookback (looking ahead) is refused at call time."""
    if name in OPERATORS:
        raise ValueError(f"operator {name} exists")

    def add(build):
        OPERATORS[name] = Operator(arity, scope, build, normalize or (lambda p: _exact(p)), lookback or (lambda p: 0))
        return build

    return add


def _exact(p: dict, *names: str) -> dict:
    if set(p) != set(names):
        raise ValueError(f"parameters must be {names}, not {sorted(p)}")
    return p


def _whole(p: dict, name: str, least: int) -> int:
    v = p[name]
    if isinstance(v, bool) or not isinstance(v, int) or v < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    return v


def _periods(least: int):
    return lambda p: {"periods": _whole(_exact(p, "periods"), "periods", least)}


def _window(extra: dict | None = None):
    def normalize(p: dict) -> dict:
        p = {"min_periods": p.get("window"), **(extra or {}), **p}
        _exact(p, "window", "min_periods", *(extra or {}))
        _whole(p, "window", 1)
        if _whole(p, "min_periods", 1) > p["window"]:
            raise ValueError("min_periods exceeds window")
        if extra:
            _whole(p, "ddof", 0)
        return {k: p[k] for k in ("window", "min_periods", *(extra or {}))}

    return normalize


def _exponent(p: dict) -> dict:
    v = _exact(p, "exponent")["exponent"]
    if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
        raise ValueError("exponent must be finite")
    return {"exponent": float(v)}


def _quantiles(p: dict) -> dict:
    p = _exact({"lower": 0.01, "upper": 0.99, **p}, "lower", "upper")
    if not 0 <= p["lower"] < p["upper"] <= 1:
        raise ValueError("need 0 <= lower < upper <= 1")
    return {k: float(p[k]) for k in ("lower", "upper")}


def column(name: str) -> Node:
    return Node("column", (), (("name", str(name)),))


def constant(value: float) -> Node:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError("a constant must be a finite number")
    return Node("constant", (), (("value", float(value)),))


def call(name: str, /, *inputs, **parameters) -> Node:
    if name in ("column", "constant"):
        return column(parameters["name"]) if name == "column" else constant(parameters["value"])
    if name not in OPERATORS:
        raise ValueError(f"no operator {name}")
    op = OPERATORS[name]
    if len(inputs) != op.arity:
        raise ValueError(f"{name} takes {op.arity} inputs")
    nodes = tuple(x if isinstance(x, Node) else constant(x) for x in inputs)
    fixed = op.normalize(parameters)
    if op.lookback(fixed) < 0:
        raise ValueError(f"{name} looks ahead")
    return Node(name, nodes, tuple(fixed.items()))


def parse(source: str) -> Node:
    """Calls, names, numbers, + - * / and comparisons; anything else is refused."""
    if len(source) > MAX_SOURCE:
        raise ValueError("expression too long")
    binary = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide"}
    compare = {ast.Lt: "less_than", ast.LtE: "less_equal", ast.Gt: "greater_than", ast.GtE: "greater_equal", ast.Eq: "equal", ast.NotEq: "not_equal"}

    def scalar(x):
        v = ast.literal_eval(x)
        if v is not None and not isinstance(v, (str, int, float, bool)):
            raise ValueError("parameters must be scalars")
        return v

    def walk(x) -> Node:
        match x:
            case ast.Name(id=name):
                return column(name)
            case ast.Constant(value=v):
                return constant(v)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in binary:
                return call(binary[type(op)], walk(a), walk(b))
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)):
                return constant(-v)
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return call("negative", walk(a))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in compare:
                return call(compare[type(op)], walk(a), walk(b))
            case ast.Call(func=ast.Name(id="column"), args=[ast.Constant(value=str(name))], keywords=[]):
                return column(name)
            case ast.Call(func=ast.Name(id="constant"), args=[v], keywords=[]):
                return constant(scalar(v))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=kw):
                if len({k.arg for k in kw}) != len(kw) or any(k.arg is None for k in kw):
                    raise ValueError("bad keywords")
                return call(name, *map(walk, args), **{k.arg: scalar(k.value) for k in kw})
        raise ValueError(f"not allowed: {ast.dump(x)[:80]}")

    try:
        tree = ast.parse(source.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {source[:80]}") from e
    return walk(tree.body)


# ---- element-wise

for _name, _make in {
    "add": lambda a, b: finite(a + b), "subtract": lambda a, b: finite(a - b), "multiply": lambda a, b: finite(a * b), "divide": ratio,
    "less_than": lambda a, b: F.coalesce(a < b, F.lit(False)), "less_equal": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "greater_than": lambda a, b: F.coalesce(a > b, F.lit(False)), "greater_equal": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "equal": lambda a, b: F.coalesce(a == b, F.lit(False)), "not_equal": lambda a, b: F.coalesce(a != b, F.lit(False)),
}.items():
    register_operator(_name, 2)(_make)
for _name, _make in {"negative": lambda a: -a, "absolute": F.abs, "log": F.ln, "sign": F.signum}.items():
    register_operator(_name, 1)(_make)
register_operator("power", 1, normalize=_exponent)(lambda a, exponent: finite(F.pow(a, F.lit(exponent))))
register_operator("signed_power", 1, normalize=_exponent)(lambda a, exponent: finite(F.signum(a) * F.pow(F.abs(a), F.lit(exponent))))
register_operator("where", 3)(lambda c, a, b: F.when(F.coalesce(c.cast("double") != 0, F.lit(False)), a).otherwise(b))

# ---- time series: rows of one code in date order, today included


def _over(n: int | None = None):
    w = Window.partitionBy(KEYS[0]).orderBy(KEYS[1])
    return w if n is None else w.rowsBetween(1 - n, 0)


def _lagged(a: Column, periods: int) -> Column:
    return a if periods == 0 else F.lag(a, periods).over(_over())


def _gated(a: Column, value: Column, window: int, min_periods: int, least: int = 1) -> Column:
    return F.when(F.count(a).over(_over(window)) >= max(min_periods, least), value)


_back = lambda p: p["periods"]
_span = lambda p: p["window"] - 1
register_operator("delay", 1, "time", _periods(0), _back)(_lagged)
register_operator("delta", 1, "time", _periods(1), _back)(lambda a, periods: finite(a - _lagged(a, periods)))
register_operator("returns", 1, "time", _periods(1), _back)(lambda a, periods: ratio(a, _lagged(a, periods)) - 1)
for _name, _make in {"ts_sum": F.sum, "ts_mean": F.avg, "ts_min": F.min, "ts_max": F.max}.items():
    register_operator(_name, 1, "time", _window(), _span)(lambda a, window, min_periods, f=_make: _gated(a, f(a).over(_over(window)), window, min_periods))


@register_operator("ts_stddev", 1, "time", _window({"ddof": 1}), _span)
def _stddev(a, window, min_periods, ddof):
    w = _over(window)
    n = F.count(a).over(w)
    if ddof == 1:
        value = F.stddev_samp(a).over(w)
    else:
        value = F.sqrt(ratio(F.var_pop(a).over(w) * n, n - ddof))
    return F.when((n >= min_periods) & (n > ddof), value)


def _values(a: Column, window: int) -> Column:
    """The window's values with its NULLs, oldest first (collect_list drops bare NULLs, not structs)."""
    return F.transform(F.collect_list(F.struct(a.alias("v"))).over(_over(window)), lambda x: x["v"])


for _name, _make in {"ts_argmax": F.max, "ts_argmin": F.min}.items():
    register_operator(_name, 1, "time", _window(), _span)(
        lambda a, window, min_periods, f=_make: _gated(a, F.array_position(_values(a, window), f(a).over(_over(window))).cast("double"), window, min_periods)
    )


@register_operator("ts_rank", 1, "time", _window(), _span)
def _ts_rank(a, window, min_periods):
    v = _values(a, window)
    below, same = F.size(F.filter(v, lambda x: x < a)), F.size(F.filter(v, lambda x: x == a))
    return F.when(a.isNotNull(), _gated(a, (below + (same + 1) / 2) / F.count(a).over(_over(window)), window, min_periods))


def _paired(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


@register_operator("ts_correlation", 2, "time", _window(), _span)
def _correlation(a, b, window, min_periods):
    x, y = _paired(a, b)
    w = _over(window)
    # variance within rounding noise of the values' size counts as none
    varies = [F.when(F.var_pop(v).over(w) > 1e-14 * F.avg(v * v).over(w), F.var_pop(v).over(w)) for v in (x, y)]
    return _gated(x, ratio(F.covar_pop(x, y).over(w), F.sqrt(varies[0] * varies[1])), window, min_periods)


@register_operator("ts_covariance", 2, "time", _window(), _span)
def _covariance(a, b, window, min_periods):
    x, y = _paired(a, b)
    return _gated(x, F.covar_samp(x, y).over(_over(window)), window, min_periods, 2)


# ---- cross sections: all codes of one date


def average_rank(value: Column, *partition: Column | str) -> Column:
    """1-based rank with ties averaged, NULL for NULL."""
    ordered = Window.partitionBy(*partition, value.isNull()).orderBy(value)
    alike = Window.partitionBy(*partition, value)
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(alike) - 1) / 2)


def _day():
    return Window.partitionBy(KEYS[1])


register_operator("cs_rank", 1, "cross")(lambda a: average_rank(a, KEYS[1]) / F.count(a).over(_day()))
register_operator("cs_demean", 1, "cross")(lambda a: a - F.avg(a).over(_day()))
register_operator("cs_zscore", 1, "cross")(lambda a: ratio(a - F.avg(a).over(_day()), F.stddev_pop(a).over(_day())))
register_operator("cs_scale", 1, "cross")(lambda a: ratio(a, F.sum(F.abs(a)).over(_day())))
register_operator("cs_winsorize", 1, "cross", _quantiles)(
    lambda a, lower, upper: F.when(a.isNotNull(), F.least(F.greatest(a, F.percentile(a, lower).over(_day())), F.percentile(a, upper).over(_day())))
)


def levels(nodes: list[Node]) -> dict[Node, int]:
    """For each distinct node the projection in which it becomes a column."""
    found: dict[Node, int] = {}

    def walk(n: Node) -> int:
        if n not in found:
            below = max((walk(x) for x in n.inputs), default=0)
            scope = "element" if n.operator in ("column", "constant") else OPERATORS[n.operator].scope
            found[n] = below if scope == "element" else below + 1
        return found[n]

    for n in nodes:
        walk(n)
    return found


def evaluate(frame: DataFrame, expressions: dict[str, Node | str]) -> DataFrame:
    """frame with one double column per expression (booleans as 1.0 and 0.0)."""
    nodes = {name: parse(e) if isinstance(e, str) else e for name, e in expressions.items()}
    if ahead := [name for name, n in nodes.items() if not n.causal]:
        raise ValueError(f"these look ahead: {ahead}")
    missing = set().union(*(n.columns for n in nodes.values())) - set(frame.columns) if nodes else set()
    if missing:
        raise ValueError(f"unknown columns {sorted(missing)}")
    level = levels(list(nodes.values()))
    names = {n: f"__{n.identity}" for n in level}

    def inline(n: Node, at: int) -> Column:
        """n as an expression inside projection `at`: columns of earlier projections by name."""
        if n.operator == "column":
            return finite(F.col(f"`{n.param('name')}`"))
        if n.operator == "constant":
            return F.lit(n.param("value"))
        op = OPERATORS[n.operator]
        if op.scope != "element" and level[n] < at:
            return F.col(names[n])
        return op.build(*(inline(x, at) if op.scope == "element" else F.col(names[x]) for x in n.inputs), **dict(n.parameters))

    out = frame
    top = max(level.values(), default=0)
    for k in range(1, top + 1):
        windows = [n for n in level if level[n] == k and n.operator not in ("column", "constant") and OPERATORS[n.operator].scope != "element"]
        inputs = {x for n in windows for x in n.inputs if names[x] not in out.columns}
        if inputs:
            out = out.select("*", *(inline(x, k).alias(names[x]) for x in sorted(inputs, key=lambda x: x.canonical)))
        out = out.select("*",
            *(OPERATORS[n.operator].build(*(F.col(names[x]) for x in n.inputs), **dict(n.parameters)).alias(names[n]) for n in sorted(windows,
            key=lambda n: n.canonical)))
    return out.select(*[F.col(f"`{c}`") for c in frame.columns], *(inline(n, top + 1).cast("double").alias(name) for name, n in nodes.items()))
