"""Market data sources behind one interface, and their registry: bars in, features out."""

from __future__ import annotations

import dataclasses
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors
from ..operators import market
from ..operators.store import DailyStore
from .readers import read_bars, validated

ADJUST = ("none", "qfq", "hfq")
SOURCES: dict[str, type[MarketDataSource]] = {}
DEFAULT_SOURCE = "market_service"


class MarketDataSource(ABC):
    """A named source of bars of one frequency; its options are its dataclass fields."""

    name: str = ""
    frequency: str = ""
    provides_intraday: bool = False

    @abstractmethod
    def metadata(self) -> dict: ...

    @abstractmethod
    def list_symbols(self, limit: int) -> list[str]: ...

    @abstractmethod
    def load_bars(self, codes: list[str] | None, start, end) -> DataFrame: ...

    @abstractmethod
    def build_features(self, bars: DataFrame, names: list[str] | None = None, expressions: dict | None = None,
        cache: factors.FactorCache | None = None) -> DataFrame: ...

    def cache_namespace(self) -> str:
        """What sets this source's numbers apart from those of the same name elsewhere."""
        return self.name

    def describe(self) -> str:
        return f"{self.name} ({self.frequency})"


def register_source(kind: type[MarketDataSource]) -> type[MarketDataSource]:
    if not isinstance(kind, type) or not issubclass(kind, MarketDataSource):
        raise TypeError("only MarketDataSource classes are registered")
    if not kind.name.strip():
        raise ValueError(f"{kind.__name__} has no name")
    if kind.name in SOURCES:
        raise ValueError(f"source {kind.name} exists")
    SOURCES[kind.name] = kind
    return kind


def available_sources() -> list[str]:
    return sorted(SOURCES)


def source_options(name: str) -> list[str]:
    """Names of a source's options."""
    if name not in SOURCES:
        raise ValueError(f"no source {name}; there are {available_sources()}")
    return [f.name for f in dataclasses.fields(SOURCES[name]) if f.name != "spark"]


def open_source(spark: SparkSession, name: str = DEFAULT_SOURCE, **options) -> MarketDataSource:
    if wrong := set(options) - set(source_options(name)):
        raise ValueError(f"{name} has no options {sorted(wrong)}")
    return SOURCES[name](spark, **options)


@register_source
@dataclass
class MarketServiceSource(MarketDataSource):
    """Minute bars of a year/month store; features on days made of them, intraday factors included."""

    spark: SparkSession
    path: str

    name = "market_service"
    frequency = "5m"
    provides_intraday = True

    def _bars(self) -> DataFrame:
        return read_bars(self.spark, self.path)

    def metadata(self) -> dict:
        return self._bars().agg(F.min("trade_time").alias("first_time"), F.max("trade_time").alias("last_time"), F.count(F.lit(1)).alias("rows"),
            F.countDistinct("code").alias("symbols")).first().asDict()

    def list_symbols(self, limit: int) -> list[str]:
        return [r.code for r in market.search_symbols(self._bars(), "", limit).collect()]

    def kline(self, code: str, start, end, period: str = "15m") -> DataFrame:
        """K-lines of a code whose buckets start in [start aligned down, end], with pre_close seeded from before."""
        if str(start) > str(end):
            raise ValueError("start after end")
        lines = market.with_pre_close(market.kline(self._dated(read_bars(self.spark, self.path, None, end, [code.strip().upper()], closed=True)), period))
        first = market.bucket_of(F.lit(start).cast("timestamp"), period)
        return lines.filter(F.col("bucket") >= first)

    def snapshot(self, at, codes: list[str] | None = None) -> DataFrame:
        return market.snapshot(read_bars(self.spark, self.path, at, at, codes, closed=True), at)

    def raw(self, conditions: list, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of the bars that meet all conditions, in order of time and code, with their total."""
        return market.raw_page(self._bars(), conditions, ["trade_time", "code"], limit, offset)

    @staticmethod
    def _dated(bars: DataFrame) -> DataFrame:
        if "trade_date" not in bars.columns:
            bars = bars.withColumn("trade_date", F.to_date("trade_time"))
        return bars if "seq" in bars.columns else bars.withColumn("seq", F.lit(0))

    def load_bars(self, codes, start, end) -> DataFrame:
        """Bars of [start, end], valid and of different (code, trade_time); no codes, no bars."""
        bars = read_bars(self.spark, self.path, start, end, codes, closed=True)
        key = ("code", "trade_time", "seq") if "seq" in bars.columns else ("code", "trade_time")
        return validated(bars, key)

    def build_features(self, bars, names=None, expressions=None, cache=None) -> DataFrame:
        bars = self._dated(bars)
        return factors.build(market.daily(bars), names, bars, expressions)


@register_source
@dataclass
class DailySource(MarketDataSource):
    """Daily bars of a synced store: adjusted, by default backwards; suspended days and adjusted volume on request.

    Rows that break the bar contract raise, or with broken="drop" are left out.
    """

    spark: SparkSession
    root: str
    landed: str = ""
    adjust: str = "hfq"
    adjust_anchor: object = None
    include_suspended: bool = False
    adjust_volume: bool = False
    sync: bool = False
    broken: str = "raise"

    name = "qmt_daily"
    frequency = "1d"
    provides_intraday = False

    def __post_init__(self):
        if self.adjust not in ADJUST:
            raise ValueError(f"adjust is one of {ADJUST}")
        self.store = DailyStore(self.spark, self.root, self.landed)
        if self.sync:
            self.store.sync()
        if self.adjust == "qfq" and self.adjust_anchor is None:
            self.adjust_anchor = self.store.metadata().get("adjust_anchor_date") or None
            if self.adjust_anchor is None:
                raise ValueError("qfq needs adjust_anchor: the store has recorded none")

    def metadata(self) -> dict:
        bars = self.store.table("monthly_inventory").agg(F.min("min_date").alias("first_date"), F.max("max_date").alias("last_date"),
            F.sum("rows").alias("rows")).first()
        return self.store.metadata() | bars.asDict()

    def universe(self, start=None, end=None) -> DataFrame:
        m = self.metadata()
        return market.universe_over(self.store.table("instruments"), start or m["first_date"], end or m["last_date"])

    def list_symbols(self, limit: int) -> list[str]:
        return [r.code for r in self.universe().select("code").orderBy("code").limit(limit).collect()]

    def actions(self, codes=None, end=None) -> DataFrame:
        out = self.store.table("corporate_actions")
        out = out if end is None else out.filter(F.col("ex_date") <= F.lit(end).cast("date"))
        return out if codes is None else out.filter(F.col("code").isin(codes))

    def calendar(self, start, end) -> DataFrame:
        return self.store.table("trading_calendar").filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    def load_bars(self, codes, start, end) -> DataFrame:
        """Adjusted bars of [start, end]. Actions are read up to the later of end and anchor, so that a narrower window gives the same numbers."""
        bars = self.store.bars(start, end, codes, self.include_suspended)
        until = max(str(end)[:10], str(self.adjust_anchor or "")[:10])
        out = market.adjust(bars, self.actions(codes, until), self.adjust, self.adjust_anchor, self.adjust_volume)
        return validated(out, broken=self.broken)

    def build_features(self, bars, names=None, expressions=None, cache=None) -> DataFrame:
        chosen = factors.select_factors(names if names is not None or not expressions else [], False)
        wanted = {n: factors.FACTORS[n] for n in chosen} | (expressions or {})
        if cache is not None:
            return cache.build(bars, wanted, self.cache_namespace())
        return factors.build(bars, chosen, None, expressions)

    def cache_namespace(self) -> str:
        parts = [self.name, self.adjust, str(self.adjust_anchor or "-"), "with_suspended" if self.include_suspended else "no_suspended",
            "adjusted_volume" if self.adjust_volume else "raw_volume"] + (["sound_rows"] if self.broken == "drop" else [])
        return "/".join(parts)
