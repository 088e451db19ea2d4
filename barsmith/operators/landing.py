"""Vendor rows to landing partitions: bars, instruments, actions and the calendar, with the issues met on the way."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import classify_board, finite_number, is_risk_warned, normalize_date, normalize_lifecycle_date, optional_bool
from .issues import issue, said, union

c = F.col
#: The vendor's names of the kline fields.
KLINE_FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "preClose": "pre_close", "volume": "volume", "amount": "amount",
    "suspendFlag": "suspend_flag"}
ACTION_TERMS = [
    "cash_dividend_per_share", "bonus_share_per_share", "capitalization_per_share", "rights_issue_per_share", "rights_issue_price",
    "share_reform_flag", "adjustment_factor",
]


# ---- bars


def parse_kline(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Vendor bars (code, time, vendor fields as text) to code, trade_date, numbers: dates from start to end; missing fields and what is no finite
    number become NULL."""
    day = normalize_date(c("time"))
    values = [(finite_number(c(f"`{v}`")) if v in raw.columns else F.lit(None).cast("double")).alias(n) for v, n in KLINE_FIELDS.items()]
    return raw.select("code", day.alias("trade_date"), *values).filter(c("trade_date").between(start, end))


def _complete():
    out = F.lit(True)
    for n in ("open", "high", "low", "close"):
        out &= c(n).isNotNull()
    return out


def kline_issues(bars: DataFrame) -> DataFrame:
    """Repeated keys, incomplete prices, high or low beyond the others, negative quantities."""
    key = {"code": c("code"), "trade_date": F.try_to_date("trade_date", "yyyyMMdd")}
    repeated = bars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("code", "trade_date"))).filter("n > 1")
    high = c("high") < F.greatest("open", "close", "low")
    found = [
        (~_complete(), issue("KLINE_FIELD_INVALID", "kline_1d", "WARNING", **key, field="open,high,low,close")),
        (_complete() & high, issue("INVALID_OHLC_RELATION", "kline_1d", "ERROR", **key, field="high", actual=said(c("high")))),
        (_complete() & ~high & (c("low") > F.least("open", "close", "high")),
        issue("INVALID_OHLC_RELATION", "kline_1d", "ERROR", **key, field="low", actual=said(c("low")))),
        *[(c(n) < 0, issue("NEGATIVE_TURNOVER", "kline_1d", "ERROR", **key, field=n, actual=said(c(n)))) for n in ("volume", "amount")],
    ]
    rows = bars.select(F.explode(F.array_compact(F.array(*[F.when(t, F.struct(*x)) for t, x in found]))).alias("x")).select("x.*")
    return repeated.select(*issue("KLINE_DUPLICATE_KEY", "kline_1d", **key, field="code,trade_date")).unionByName(rows)


def corrected(bars: DataFrame) -> DataFrame:
    """bars, with high raised to the largest of open, close and low, then low lowered to the least of open, close and that high; rows with all four
    prices only. old_high and old_low keep what was changed."""
    high = F.when(_complete(), F.greatest("high", "open", "close", "low")).otherwise(c("high"))
    low = F.when(_complete(), F.least("low", "open", "close", high)).otherwise(c("low"))
    return bars.withColumns({"high": high, "low": low, "old_high": F.when(high != c("high"), c("high")), "old_low": F.when(low != c("low"), c("low"))})


def correction_log(fixed: DataFrame) -> DataFrame:
    """code, trade_date, field, original_value, corrected_value of corrected() rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), c(f"old_{f}").alias("original_value"), c(f).alias("corrected_value")) for f in ("high", "low")])).alias("x")
    return fixed.select("code", "trade_date", pairs).select("code", "trade_date", "x.*").filter("original_value IS NOT NULL")


def alive_pairs(pairs: DataFrame, instruments: DataFrame) -> DataFrame:
    """pairs (code, trade_date text) of codes that live on that day, both ends included; codes without a life always do."""
    life = instruments.select("code", c("open_date").alias("__o"), c("expire_date").alias("__x"))
    return pairs.join(life, "code", "left").filter("(__o IS NULL OR trade_date >= __o) AND (__x IS NULL OR trade_date <= __x)").drop("__o", "__x")


def missing_issues(bars: DataFrame, codes: DataFrame, dates: DataFrame, instruments: DataFrame) -> DataFrame:
    """Days of a code's life without a bar. Pairs are made code by code from the array of dates, so no table is crossed with another."""
    days = dates.agg(F.sort_array(F.collect_set("trade_date")).alias("days"))
    pairs = codes.select("code").distinct().crossJoin(F.broadcast(days)).select("code", F.explode("days").alias("trade_date"))
    gone = alive_pairs(pairs, instruments).join(bars.select("code", "trade_date").distinct(), ["code", "trade_date"], "left_anti")
    return gone.select(*issue("DATE_SYMBOLS_MISSING", "kline_1d", "WARNING", code=c("code"), trade_date=F.try_to_date("trade_date", "yyyyMMdd")))


def kline_batch(raw: DataFrame, codes: DataFrame, dates: DataFrame, instruments: DataFrame, start: str, end: str) -> dict[str, DataFrame]:
    """The whole batch: bars as they land (corrected), the corrections and all issues, dates on which nothing came."""
    fixed = corrected(parse_kline(raw, start, end).dropDuplicates(["code", "trade_date"]))
    bars = fixed.drop("old_high", "old_low")
    empty = dates.join(bars.select("trade_date").distinct(), "trade_date", "left_anti")
    return {
        "bars": bars, "corrections": correction_log(fixed), "empty_dates": empty,
        "issues": union(kline_issues(bars), missing_issues(bars, codes, dates, instruments),
        empty.select(*issue("MISSING_DATE_PARTITION", "kline_1d", trade_date=F.try_to_date("trade_date", "yyyyMMdd")))),
    }


# ---- instruments


def lifecycle_frame(raw: DataFrame, key: str = "code") -> DataFrame:
    """The instrument snapshot, all text, as the store has it: dates, flags, board and warning; the first row (by seq) of a key, empty codes left out.

    key: what tells instruments apart, the normalised code as in the store, or another column where codes are not unique.
    """
    have = set(raw.columns)
    text = lambda n: F.trim(F.coalesce(c(n), F.lit(""))) if n in have else F.lit("")
    date = lambda n: normalize_lifecycle_date(c(n)) if n in have else F.lit(None).cast("date")
    x = raw.withColumn("code", F.upper(F.trim("code"))).filter("code <> ''")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).filter("place = 1")
    return x.select(
        "code", text("instrument_name").alias("instrument_name"), date("open_date").alias("open_date"), date("expire_date").alias("expire_date"),
        (optional_bool(c("is_trading")) if "is_trading" in have else F.lit(None).cast("boolean")).alias("is_trading"),
        text("instrument_status").alias("instrument_status"),
        classify_board(c("code")).alias("board"), is_risk_warned(text("instrument_name")).alias("is_st"),
    )


def merged_history(refreshed: DataFrame, existing: DataFrame) -> DataFrame:
    """Names of one observation date: refreshed rows, and those of the existing partition for other codes."""
    return refreshed.unionByName(existing.join(refreshed.select("code"), "code", "left_anti"))


def carried_universe(current: DataFrame, previous: DataFrame, end: str) -> DataFrame:
    """code, carried: the current codes and those of the last snapshot that have a suffix and no, an unparsable or a recent expiry (the day before
    `end` or later)."""
    pool = current.select(F.upper(F.trim("code")).alias("code")).filter("code <> ''").distinct()
    expiry = F.trim(F.coalesce("expire_date", F.lit("")))
    parsed = F.try_to_date(F.when(expiry.rlike("^[0-9]{8}$"), expiry), "yyyyMMdd")
    kept = parsed.isNull() | (parsed >= F.date_sub(F.to_date(F.lit(end), "yyyyMMdd"), 1))
    old = previous.withColumn("code", F.upper(F.trim("code"))).filter(c("code").contains(".") & kept).select("code").distinct()
    return pool.withColumn("carried", F.lit(False)).unionByName(old.join(pool, "code", "left_anti").withColumn("carried", F.lit(True)))


# ---- actions


def parse_actions(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Vendor records (code, time, values: array of text) of ex dates from start to end with all seven terms."""
    day = normalize_date(c("time"))
    out = raw.withColumn("ex_date", day).filter(c("ex_date").between(start, end) & (F.size("values") >= len(ACTION_TERMS)))
    return out.select("code", "ex_date", *[finite_number(F.element_at("values", k + 1)).alias(n) for k, n in enumerate(ACTION_TERMS)])


def action_issues(raw: DataFrame, start: str, end: str) -> DataFrame:
    short = raw.withColumn("ex_date", normalize_date(c("time"))).filter(c("ex_date").between(start, end) & (F.size("values") < len(ACTION_TERMS)))
    return short.select(*issue(F.lit("ACTION_FIELDS_MISSING"), "corporate_actions", "WARNING", code=c("code"),
        trade_date=F.try_to_date("ex_date", "yyyyMMdd"), expected="7", actual=F.size("values").cast("string")))


def action_partitions(parsed: DataFrame, dates: DataFrame) -> DataFrame:
    """ex_date, rows of every partition to write: each trading date and each date with an action, empty ones too."""
    days = dates.select(c("trade_date").alias("ex_date")).unionByName(parsed.select("ex_date")).distinct()
    return days.join(parsed.groupBy("ex_date").agg(F.count(F.lit(1)).alias("rows")), "ex_date", "left").select("ex_date",
        F.coalesce("rows", F.lit(0)).alias("rows"))


# ---- jobs


def batches(values: list, size: int) -> Iterator[list]:
    if size < 1:
        raise ValueError("a batch holds at least one")
    for k in range(0, len(values), size):
        yield values[k : k + size]


def job_key(settings: dict) -> str:
    """A name of a job by its settings: equal settings in any order give one key."""
    return "job_" + hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:20]
