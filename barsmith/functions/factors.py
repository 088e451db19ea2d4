"""Registered factors: daily ones as expressions, intraday ones as one aggregation of bars."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from . import dsl
from .scalars import finite, ratio

_RET = "returns(close, periods=1)"
_MA5, _MA20 = "ts_mean(close, window=5)", "ts_mean(close, window=20)"
_LOW, _HIGH = "ts_min(delay(low, periods=1), window=20)", "ts_max(delay(high, periods=1), window=20)"
DAILY: dict[str, str] = {
    **{f"return_{n}d": f"returns(close, periods={n})" for n in (1, 5, 10, 20)},
    "intraday_return": "close / open - 1",
    "overnight_gap": "open / delay(close, periods=1) - 1",
    "amplitude": "(high - low) / delay(close, periods=1)",
    "close_position": "where(high > low, (close - low) / (high - low), 0.5)",
    "candle_body_ratio": "where(high > low, absolute(close - open) / (high - low), divide(1, 0))",
    "close_to_ma_5d": f"close / {_MA5} - 1",
    "ma_5d_slope": f"returns({_MA5}, periods=1)",
    "ma_distance_change_5d": f"delta(close / {_MA5} - 1, periods=1)",
    "ma_spread_5d_20d": f"{_MA5} / {_MA20} - 1",
    "ma_spread_change_5d_20d": f"delta({_MA5} / {_MA20} - 1, periods=1)",
    "momentum_acceleration_5d_20d": "log(close / delay(close, periods=5)) / 5 - log(close / delay(close, periods=20)) / 20",
    "breakout_strength_20d": "close / ts_max(delay(close, periods=1), window=20) - 1",
    "channel_position_20d": f"where({_HIGH} > {_LOW}, (close - {_LOW}) / ({_HIGH} - {_LOW}), divide(1, 0))",
    "volatility_5d": f"ts_stddev({_RET}, window=5, min_periods=3)",
    "up_days_ratio_5d": f"ts_mean(where({_RET} > -2, where({_RET} > 0, 1, 0), divide(1, 0)), window=5)",
    "volume_ratio_5d": "volume / ts_mean(volume, window=5, min_periods=3)",
    "alpha_001": f"cs_rank(ts_argmax(signed_power(where({_RET} < 0, ts_stddev({_RET}, window=20), close), exponent=2.0), window=5))",
    "alpha_002": "negative(ts_correlation(cs_rank(delta(log(volume), periods=2)), cs_rank((close - open) / open), window=6))",
}
INTRADAY = ("realized_vol", "downside_semivol", "intraday_path_efficiency", "last_30m_return", "last_30m_volume_ratio", "positive_bar_ratio",
    "signed_volume_imbalance", "close_to_vwap")
FACTORS: dict[str, dsl.Node | str] = dict(DAILY)
#: How a factor scales when all prices of a code do: degree 0 unless listed; None: not homogeneous.
PRICE_HOMOGENEITY: dict[str, int | None] = {"alpha_001": None}


def register_factor(name: str, expression: dsl.Node | str, price_homogeneity: int | None = 0) -> None:
    """A named daily factor; other expressions may use its name as if it were a column."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no identifier")
    if name in FACTORS or name in INTRADAY:
        raise ValueError(f"factor {name} exists")
    if isinstance(price_homogeneity, bool) or not isinstance(price_homogeneity, (int, type(None))):
        raise TypeError("price_homogeneity is a whole number or None")
    FACTORS[name] = dsl.parse(expression) if isinstance(expression, str) else expression
    if price_homogeneity != 0:
        PRICE_HOMOGENEITY[name] = price_homogeneity


def requires_intraday(name: str) -> bool:
    return name in INTRADAY


def daily_capable() -> list[str]:
    return sorted(FACTORS)


def homogeneity(name: str) -> int | None:
    if name not in FACTORS and name not in INTRADAY:
        raise ValueError(f"no factor {name}")
    return PRICE_HOMOGENEITY.get(name, 0)


def resolved(expression: dsl.Node | str, columns: set[str]) -> tuple[dsl.Node, set[str]]:
    """The expression with registered factors' names (that are no columns) replaced by their expressions; and the intraday factors it needs."""
    intraday: set[str] = set()

    def walk(n: dsl.Node, within: tuple[str, ...]) -> dsl.Node:
        if n.operator != "column":
            return dsl.Node(n.operator, tuple(walk(x, within) for x in n.inputs), n.parameters)
        name = n.param("name")
        if name in columns:
            return n
        if name in INTRADAY:
            intraday.add(name)
            return n
        if name not in FACTORS:
            raise ValueError(f"unknown column or factor {name!r}")
        if name in within:
            raise ValueError(f"factors in a circle: {' > '.join([*within, name])}")
        own = FACTORS[name]
        return walk(dsl.parse(own) if isinstance(own, str) else own, (*within, name))

    return walk(dsl.parse(expression) if isinstance(expression, str) else expression, ()), intraday


def select_factors(names: list[str] | None, has_bars: bool) -> list[str]:
    """The factors to build: those named, or all that the source allows; naming an intraday one without minute bars is an error."""
    if names is None:
        if not has_bars:
            warnings.warn(f"no minute bars: {', '.join(INTRADAY)} are left out", stacklevel=2)
        return [*FACTORS, *(INTRADAY if has_bars else ())]
    if unknown := [n for n in names if n not in FACTORS and n not in INTRADAY]:
        raise ValueError(f"no such factors: {unknown}")
    if not has_bars and (wrong := [n for n in names if n in INTRADAY]):
        raise ValueError(f"need minute bars: {wrong}")
    return list(names)


def build(daily: DataFrame, names: list[str] | None = None, bars: DataFrame | None = None, expressions: dict[str, dsl.Node | str] | None = None) -> DataFrame:
    """daily (code, trade_date, open, high, low, close, volume) with the named factors and expressions, which may use factors by name.

    bars: minute bars, for intraday factors; those needed are one aggregation, joined by day.
    """
    chosen = select_factors(names if names is not None or not expressions else [], bars is not None)
    columns = set(daily.columns)
    wanted: dict[str, dsl.Node] = {}
    from_bars = {n for n in chosen if n in INTRADAY}
    for name, e in [*((n, FACTORS[n]) for n in chosen if n in FACTORS), *(expressions or {}).items()]:
        if name in columns or name in wanted:
            raise ValueError(f"{name!r} is there already")
        wanted[name], needed = resolved(e, columns)
        from_bars |= needed
    if from_bars and bars is None:
        raise ValueError(f"need minute bars: {sorted(from_bars)}")
    out = daily.join(intraday(bars).select(*dsl.KEYS, *sorted(from_bars)), list(dsl.KEYS), "left") if from_bars else daily
    out = dsl.evaluate(out, wanted)
    return out.select(*[F.col(f"`{c}`") for c in daily.columns], *[c for c in chosen if c in INTRADAY], *wanted)


class FactorCache:
    """Factor columns kept as Parquet by what they compute and from what: (namespace, canonical expression, digest of the input).

    A file whose keys differ from the input's is not used. Tables are written whole before they count.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    @staticmethod
    def digest(daily: DataFrame) -> str:
        """Order-free digest of all rows and columns, from one aggregation."""
        row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(daily.columns)])
        got = daily.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
        return hashlib.sha256("|".join([*sorted(daily.columns), *map(str, got)]).encode()).hexdigest()[:16]

    def build(self, daily: DataFrame, expressions: dict[str, dsl.Node | str], namespace: str = "default") -> DataFrame:
        """daily with the expressions' columns; those cached for this input are read, the others computed once and written."""
        columns, spark = set(daily.columns), daily.sparkSession
        nodes = {name: resolved(e, columns)[0] for name, e in expressions.items()}
        digest = self.digest(daily)
        where = {name: f"{self.path}/{namespace}/{n.identity}-{digest}" for name, n in nodes.items()}
        missing = {name: n for name, n in nodes.items() if not files.exists(spark, f"{where[name]}/_SUCCESS")}
        if missing:
            computed = dsl.evaluate(daily, missing)
            for name in missing:
                computed.select(*dsl.KEYS, F.col(name).alias("value")).write.mode("overwrite").parquet(where[name])
        out = daily
        for name in nodes:
            held = spark.read.parquet(where[name])
            if held.count() != daily.count():
                raise ValueError(f"cached {name} does not fit its input")
            out = out.join(held.withColumnRenamed("value", name), list(dsl.KEYS), "left")
        return out


def _quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite, or NaN for 0 / 0, where b is 0."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


def intraday(bars: DataFrame, last: int = 6) -> DataFrame:
    """The eight intraday factors per (code, trade_date) of bars (code, trade_date, trade_time, seq, open, close, volume)."""
    day = Window.partitionBy("code", "trade_date")
    up, down = day.orderBy("trade_time", "seq"), day.orderBy(F.col("trade_time").desc(), F.col("seq").desc())
    b = bars.select("code", "trade_date", "trade_time", "seq", "open", "close", F.col("volume").cast("double").alias("volume"))
    b = b.withColumn("before", F.lag("close").over(up)).withColumn("place", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down))
    b = b.withColumn("day_open", F.first("open").over(up))
    b = b.withColumn("ret", ratio(F.col("close"), F.col("before")) - 1).withColumn("move", ratio(F.col("close"), F.coalesce("before", "day_open")) - 1)
    first, end = F.min_by("open", F.struct("trade_time", "seq")), F.max_by("close", F.struct("trade_time", "seq"))
    late = F.col("from_end") <= last
    volume = F.sum("volume")
    step = F.abs(F.col("close") - F.coalesce("before", "day_open"))
    some = lambda gate, value: finite(F.when(gate, value))
    return b.groupBy("code", "trade_date").agg(
        some(F.count(F.lit(1)) > 2, F.stddev_samp("ret")).alias("realized_vol"),
        F.sqrt(F.avg(F.pow(F.least("move", F.lit(0.0)), 2))).alias("downside_semivol"),
        ratio(end - first, F.when(F.sum(step) > 0, F.sum(step))).alias("intraday_path_efficiency"),
        (_quotient(end, F.min_by(F.when(late, F.col("close")), F.when(late, F.struct("trade_time", "seq")))) - 1).alias("last_30m_return"),
        ratio(F.sum(F.when(late, F.col("volume"))), volume).alias("last_30m_volume_ratio"),
        F.avg(F.when(F.col("ret").isNotNull(), F.when(F.col("ret") > 0, 1.0).otherwise(0.0))).alias("positive_bar_ratio"),
        some(volume > 0, ratio(F.sum(F.signum("move") * F.col("volume")), volume)).alias("signed_volume_imbalance"),
        some(volume > 0, ratio(end, ratio(F.sum(F.col("close") * F.col("volume")), volume)) - 1).alias("close_to_vwap"),
    )
