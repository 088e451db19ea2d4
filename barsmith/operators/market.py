"""Bars: resampling, price adjustment, universes and point-in-time values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio

MINUTES = {"5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "60m": "60 minutes"}
CALENDAR = {"1d": "day", "1w": "week", "1mo": "month"}


def bucket_of(time: Column, period: str) -> Column:
    """The start of the K-line that a time falls into."""
    if period in MINUTES:
        seconds = 60 * int(MINUTES[period].split()[0])
        return F.timestamp_seconds(F.floor(F.unix_timestamp(time) / seconds) * seconds)
    return F.date_trunc(CALENDAR[period], time)


def _bucket(period: str) -> Column:
    if period in MINUTES:
        return F.window("trade_time", MINUTES[period])["start"]
    return F.date_trunc(CALENDAR[period], "trade_time")


def ohlcv(bars: DataFrame, *keys: str | Column) -> DataFrame:
    """open, high, low, close, volume per key; first and last by (trade_time, seq) of those not NULL, so input order is irrelevant."""
    at = lambda n: F.when(F.col(n).isNotNull(), F.struct("trade_time", "seq"))
    return bars.groupBy(*keys).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"),
        F.sum("volume").alias("volume")
    )


def daily(bars: DataFrame) -> DataFrame:
    return ohlcv(bars, "code", "trade_date")


def kline(bars: DataFrame, period: str) -> DataFrame:
    """K-lines per code and bucket (weeks start on Monday)."""
    return ohlcv(bars.withColumn("bucket", _bucket(period)), "code", "bucket").withColumn("volume", F.round("volume").cast("long"))


def with_pre_close(lines: DataFrame) -> DataFrame:
    """pre_close (last valid close before), change, pct_change and intraday_pct_change; filter a range afterwards, so that it is seeded."""
    before = Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    valid = F.when(F.col("close") != 0, finite(F.col("close")))
    out = lines.withColumn("pre_close", F.last(valid, ignorenulls=True).over(before))
    return out.select(
        "*", (F.col("close") - F.col("pre_close")).alias("change"), (ratio(F.col("close"), F.col("pre_close")) * 100 - 100).alias("pct_change"),
        (ratio(F.col("close"), F.col("open")) * 100 - 100).alias("intraday_pct_change"),
    )


def snapshot(bars: DataFrame, at, codes: list[str] | None = None) -> DataFrame:
    """Bars at exactly one time."""
    out = bars.filter(F.col("trade_time") == F.lit(at))
    return out if codes is None else out.filter(F.col("code").isin(codes))


def raw_page(bars: DataFrame, conditions: list[Column], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows that meet all conditions, with their total."""
    for c in conditions:
        bars = bars.filter(c)
    total = bars.agg(F.count(F.lit(1)).alias("total"))
    return bars.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def search_symbols(bars: DataFrame, text: str, limit: int) -> DataFrame:
    return bars.select("code").distinct().filter(F.col("code").contains(text.strip().upper())).orderBy("code").limit(limit)


def inventory(bars: DataFrame, *keys: str | Column) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("code").alias("n_codes"), F.min("trade_time").alias("first_time"),
        F.max("trade_time").alias("last_time")
    )


# ---- adjustment


def cumulative_factors(actions: DataFrame) -> DataFrame:
    """code, ex_date, hfq: running product of a code's factors, one row per date; invalid factors count 1."""
    valid = F.when(finite(F.col("adjustment_factor")) > 0, F.col("adjustment_factor")).otherwise(1.0)
    by_day = actions.groupBy("code", "ex_date").agg(F.product(valid).alias("factor"))
    running = Window.partitionBy("code").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select("code", "ex_date", F.product("factor").over(running).alias("hfq"))


def asof_factor(bars: DataFrame, cumulative: DataFrame) -> DataFrame:
    """bars with hfq of the latest ex_date on or before trade_date (else 1): a union and one window, no range join."""
    marked = cumulative.select("code", F.col("ex_date").alias("__at"), F.lit(0).alias("__kind"), F.struct("hfq").alias("__f"))
    rows = bars.select("code", F.col("trade_date").alias("__at"), F.lit(1).alias("__kind"), F.struct(*[F.col(f"`{c}`") for c in bars.columns]).alias("__row"))
    upto = Window.partitionBy("code").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(marked, allowMissingColumns=True).withColumn("__hfq", F.last("__f.hfq", ignorenulls=True).over(upto))
    return out.filter("__kind = 1").select("__row.*", F.coalesce("__hfq", F.lit(1.0)).alias("hfq"))


def factor_at(cumulative: DataFrame, moment) -> DataFrame:
    return cumulative.filter(F.col("ex_date") <= F.lit(moment)).groupBy("code").agg(F.max_by("hfq", "ex_date").alias("anchor"))


def adjust(bars: DataFrame, actions: DataFrame, mode: str, anchor=None, volume: bool = False) -> DataFrame:
    """Prices times the factor of mode none, hfq or qfq (relative to its value at anchor); volume divided by it on request."""
    if mode == "qfq" and anchor is None:
        raise ValueError("qfq needs an anchor date")
    cumulative = cumulative_factors(actions)
    out = asof_factor(bars, cumulative)
    if mode == "none":
        out = out.withColumn("hfq", F.lit(1.0))
    elif mode == "qfq":
        out = out.join(factor_at(cumulative, anchor), "code", "left").withColumn("hfq", ratio(F.col("hfq"), F.coalesce("anchor", F.lit(1.0)))).drop("anchor")
    prices = [c for c in ("open", "high", "low", "close", "pre_close") if c in bars.columns]
    cols = {c: F.col(c) * F.col("hfq") for c in prices} | ({"volume": ratio(F.col("volume"), F.col("hfq"))} if volume else {})
    return out.withColumns(cols).withColumnRenamed("hfq", "factor")


def observed_ratio(daily_bars: DataFrame) -> DataFrame:
    """Yesterday's close over today's pre_close, where both are positive."""
    before = F.lag("close").over(Window.partitionBy("code").orderBy("trade_date"))
    return daily_bars.withColumn("observed", F.when((before > 0) & (F.col("pre_close") > 0), ratio(before, F.col("pre_close"))))


def theoretical_ratio(close: Column, cash: Column, bonus: Column, capital: Column, rights: Column, price: Column) -> Column:
    return ratio(close, ratio(close - cash + rights * price, 1 + bonus + capital + rights))


# ---- universe and point in time


def universe_as_of(instruments: DataFrame, as_of, min_listed_days: int = 0, boards: list[str] | None = None) -> DataFrame:
    """Listed on or before as_of less min_listed_days, not expired on it."""
    at = F.lit(as_of).cast("date")
    out = instruments.filter((F.col("open_date") <= F.date_sub(at, min_listed_days)) & (F.col("expire_date").isNull() | (F.col("expire_date") > at)))
    return out if boards is None else out.filter(F.col("board").isin(boards))


def universe_over(instruments: DataFrame, start, end) -> DataFrame:
    return instruments.filter((F.col("open_date") <= F.lit(end).cast("date"))
        & (F.col("expire_date").isNull() | (F.col("expire_date") >= F.lit(start).cast("date"))))


def point_in_time(reports: DataFrame, calendar: DataFrame, values: list[str]) -> DataFrame:
    """Per (code, trade_date) of calendar the visible report (announced strictly before) of largest (report_date, announce_date, seq).

    One running maximum over reports and dates together; no range join.
    """
    key = F.struct("report_date", "announce_date", "seq", *values)
    events = reports.select("code", F.col("announce_date").alias("__at"), F.lit(1).alias("__kind"), key.alias("__r"))
    days = calendar.select("code", F.col("trade_date").alias("__at"), F.lit(0).alias("__kind"))
    upto = Window.partitionBy("code").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = days.unionByName(events, allowMissingColumns=True).withColumn("__best", F.max("__r").over(upto)).filter("__kind = 0")
    return out.select("code", F.col("__at").alias("trade_date"), *(F.col(f"__best.{c}").alias(c) for c in ("report_date", "announce_date", *values)),
        F.col("__best").isNotNull().alias("has_finance"))
