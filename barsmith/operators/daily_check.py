"""Audit of the daily store: every rule yields rows of the one issue shape.

Predicate rules share one scan. Expected bars are exploded ordinals and an equi-join, not a range join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.limits import limit_ratio
from ..functions.scalars import finite, ratio
from .issues import issue, said, said_all, union

c = F.col


def price_tolerance(reference: Column, relative: float) -> Column:
    """A cent, prices being rounded to it, and the relative part."""
    return 0.01 + relative * F.abs(reference)


def _active() -> Column:
    return F.coalesce(c("suspend_flag"), F.lit(0)) == 0


def _positive(x: Column) -> Column:
    return F.coalesce(finite(x) > 0, F.lit(False))


# ---- rules of single rows


@dataclass(frozen=True)
class Rule:
    broken: Column
    field: str | None
    expected: Column | str
    actual: Column


def integrity_rules() -> dict[str, Rule]:
    ohlc = F.concat(F.lit("ohlc="), said(c("open")), F.lit("/"), said(c("high")), F.lit("/"), said(c("low")), F.lit("/"), said(c("close")))
    return {
        "DAILY_NULL_FIELD": Rule(c("code").isNull() | c("trade_date").isNull() | c("close").isNull(), "code/trade_date/close", "not null", F.lit("null")),
        "DAILY_NONPOSITIVE_PRICE": Rule(F.least("open", "high", "low", "close") <= 0, None, "open, high, low, close > 0", ohlc),
        "DAILY_OHLC_VIOLATION": Rule((c("high") < F.greatest("open", "close", "low")) | (c("low") > F.least("open", "close", "high")), None,
        "low <= open, close <= high", ohlc),
        "DAILY_NEGATIVE_QUANTITY": Rule((c("volume") < 0) | (c("amount") < 0), None, "volume, amount >= 0",
        said_all(("volume", c("volume")), ("amount", c("amount")))),
        "DAILY_INVALID_SUSPEND_FLAG": Rule(~c("suspend_flag").isin(0, 1), None, "0 or 1", said(c("suspend_flag"))),
        "DAILY_CODE_FORMAT_INVALID": Rule(c("code").isNotNull() & ~c("code").contains("."), None, "an exchange suffix", c("code")),
    }


def volume_rules(multiplier: Column | float = 1.0) -> dict[str, Rule]:
    zero = lambda x: F.coalesce(c(x), F.lit(0)) <= 0
    turnover = said_all(("volume", c("volume")), ("amount", c("amount")))
    vwap = ratio(c("amount"), c("volume") * multiplier)
    priced = (c("volume") > 0) & (c("amount") > 0) & (c("low") > 0) & (c("high") > 0)
    return {
        "DAILY_ACTIVE_ZERO_VOLUME": Rule(_active() & zero("volume"), "volume", "> 0 unless suspended", turnover),
        "DAILY_ACTIVE_ZERO_AMOUNT": Rule(_active() & zero("amount") & ~zero("volume"), "amount", "> 0 unless suspended", turnover),
        "DAILY_SUSPENDED_WITH_TURNOVER": Rule(~_active() & (~zero("volume") | ~zero("amount")), None, "0 while suspended", turnover),
        "DAILY_VWAP_OUT_OF_RANGE": Rule(
            _active() & priced & ((vwap < c("low") * 0.99) | (vwap > c("high") * 1.01)), None,
            F.concat(said(c("low")), F.lit(" to "), said(c("high"))), said(vwap)
        ),
    }


def rule_issues(bars: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One issue per broken (row, rule), in a single scan."""
    found = [F.when(r.broken, F.struct(*issue(k, code=c("code"), trade_date=c("trade_date"), field=r.field, expected=r.expected, actual=r.actual)))
        for k, r in rules.items()]
    return bars.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*")


def duplicate_keys(bars: DataFrame) -> DataFrame:
    n = bars.groupBy("code", "trade_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.select(*issue("DAILY_DUPLICATE_KEY", code=c("code"), trade_date=c("trade_date"), expected="1 row", actual=c("n").cast("string")))


def volume_unit(bars: DataFrame, candidates: tuple[float, ...] = (1.0, 100.0), tolerance: float = 0.2) -> DataFrame:
    """One row: median of amount / (volume * close) over active days, the multiplier of the nearest candidate (1 if none is near, or without bars),
    ambiguous."""
    m = bars.filter(_active() & (c("volume") > 0) & (c("close") > 0) & (c("amount") > 0)).agg(
        F.median(c("amount") / (c("volume") * c("close"))).alias("median"))
    away = [F.abs(c("median") / x - 1) for x in candidates]
    near = F.lit(candidates[-1])
    for x, a in zip(candidates[:-1], away[:-1], strict=True):
        near = F.when(a <= F.least(*away), x).otherwise(near)
    ok = F.least(*away) <= tolerance
    return m.select("median", F.when(ok, near).otherwise(1.0).alias("multiplier"), F.coalesce(~ok, F.lit(False)).alias("ambiguous"))


def volume_unit_issues(unit: DataFrame) -> DataFrame:
    return unit.filter("ambiguous").select(*issue("DAILY_VOLUME_UNIT_AMBIGUOUS", field="volume", expected="near 1 or 100", actual=said(c("median"))))


# ---- calendar and instruments


def ordinals(calendar: DataFrame) -> DataFrame:
    """trade_date, ordinal from 1: a calendar is one row per day, so one task orders it."""
    return calendar.select("trade_date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("trade_date")))


def calendar_issues(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Observed dates that the calendar lacks: one issue with their range and number, or that there is no calendar."""
    days = calendar.select("trade_date").distinct()
    n = days.agg(F.count(F.lit(1)).alias("n"))
    odd = bars.select("trade_date").distinct().join(days, "trade_date", "left_anti").agg(F.count(F.lit(1)).alias("odd"),
        F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    x = odd.crossJoin(F.broadcast(n))
    missing = x.filter("n = 0").select(*issue("DAILY_CALENDAR_UNAVAILABLE", expected="a trading calendar", actual="0 dates"))
    return missing.unionByName(x.filter("n > 0 AND odd > 0").select(*issue("DAILY_DATE_NOT_IN_CALENDAR", start_date=c("lo"), end_date=c("hi"),
        expected="all dates in the calendar", actual=c("odd").cast("string"))))


def effective_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """The calendar, or where it is empty the dates that bars have."""
    authoritative = calendar.select("trade_date").distinct()
    seen = bars.select("trade_date").distinct()
    none = authoritative.agg((F.count(F.lit(1)) == 0).alias("none"))
    return authoritative.unionByName(seen.crossJoin(F.broadcast(none)).filter("none").select("trade_date"))


def instrument_issues(instruments: DataFrame) -> DataFrame:
    """Missing open dates, lives that end before they begin, no instruments at all, none ever delisted."""
    i = instruments
    dates = F.concat(F.lit("open_date="), c("open_date").cast("string"), F.lit(" expire_date="), c("expire_date").cast("string"))
    totals = i.agg(F.count(F.lit(1)).alias("n"), F.count("expire_date").alias("gone"))
    return union(
        i.filter("open_date IS NULL").select(*issue("DAILY_OPEN_DATE_MISSING", dataset="instruments", code=c("code"), expected="open_date", actual="null")),
        i.filter("expire_date < open_date").select(*issue("DAILY_INVALID_LIFECYCLE_RANGE", dataset="instruments", code=c("code"),
        expected="expire_date >= open_date", actual=dates)),
        totals.filter("n = 0").select(*issue("DAILY_LIFECYCLE_UNAVAILABLE", dataset="instruments", expected="instruments", actual="0 rows")),
        totals.filter("n > 0 AND gone = 0").select(*issue("DAILY_NO_DELISTED_SYMBOLS", dataset="instruments", expected="some expire_date",
        actual=F.concat(c("n").cast("string"), F.lit(" without")))),
    )


# ---- coverage


def lives(instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """code, open_date (the calendar's first day where missing), expire_date."""
    first = calendar.agg(F.min("trade_date").alias("first"))
    return instruments.crossJoin(F.broadcast(first)).select("code", F.coalesce("open_date", "first").alias("open_date"), "expire_date")


def expected_bars(instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """code, trade_date, ordinal for each calendar day of each life."""
    days = ordinals(calendar)
    near = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z"))
    x = lives(instruments, calendar).crossJoin(F.broadcast(near))
    spans = x.select("code", F.greatest("open_date", "a").alias("s"), F.least(F.coalesce("expire_date", "z"), "z").alias("e")).filter("s <= e")
    return spans.select("code", F.explode(F.sequence("s", "e")).alias("trade_date")).join(days, "trade_date").select("code", "trade_date", "ordinal")


def coverage(expected: DataFrame, bars: DataFrame, key: str) -> DataFrame:
    """key, expected, actual, missing rows and their share."""
    have = bars.select("code", "trade_date").distinct().withColumn("here", F.lit(1))
    out = expected.join(have, ["code", "trade_date"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("expected_rows"), F.count("here").alias("actual_rows"))
    return out.withColumn("missing_rows", c("expected_rows") - c("actual_rows")).withColumn("coverage", c("actual_rows") / c("expected_rows"))


def coverage_issues(by_date: DataFrame, threshold: float = 0.95, authoritative: bool = True) -> DataFrame:
    actual = F.concat(c("actual_rows").cast("string"), F.lit("/"), c("expected_rows").cast("string"))
    return by_date.filter(c("coverage") < threshold).select(*issue("DAILY_COVERAGE_BELOW_THRESHOLD", trade_date=c("trade_date"),
        expected=f"at least {threshold:g}", actual=actual)).unionByName(
        by_date.filter("actual_rows = 0").select(
            *issue("DAILY_CALENDAR_DATE_EMPTY", level="ERROR" if authoritative else "WARNING", trade_date=c("trade_date"),
            expected=F.concat(c("expected_rows").cast("string"), F.lit(" rows")), actual="0 rows")
        )
    )


def missing_spans(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """code, first and last missing date, days of each run of consecutive missing calendar days."""
    gone = expected.join(bars.select("code", "trade_date").distinct(), ["code", "trade_date"], "left_anti")
    island = c("ordinal") - F.row_number().over(Window.partitionBy("code").orderBy("ordinal"))
    spans = gone.withColumn("island", island).groupBy("code", "island").agg(F.min("trade_date").alias("first_missing"),
        F.max("trade_date").alias("last_missing"), F.count(F.lit(1)).alias("days"))
    return spans.drop("island")


def missing_span_issues(spans: DataFrame, name: str = "DAILY_MISSING_SPAN") -> DataFrame:
    return spans.select(*issue(name, code=c("code"), start_date=c("first_missing"), end_date=c("last_missing"), expected="a row a trading day",
        actual=F.concat(c("days").cast("string"), F.lit(" days missing"))))


def internal_gaps(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """Missing spans strictly between a code's first and last bar."""
    ends = bars.groupBy("code").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    inner = expected.join(ends, "code").filter("trade_date > lo AND trade_date < hi").select("code", "trade_date", "ordinal")
    return missing_spans(inner, bars)


def lifecycle_issues(bars: DataFrame, instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars outside their life (suspended placeholders before a listing aside), and codes without one."""
    x = bars.select("code", "trade_date", "suspend_flag").join(lives(instruments, calendar), "code")
    before = (c("trade_date") < c("open_date")) & (F.coalesce(c("suspend_flag"), F.lit(0)) != 1)
    name = F.when(before, "DAILY_DATA_BEFORE_LISTING").when(c("trade_date") > c("expire_date"), "DAILY_DATA_AFTER_DELISTING")
    life = F.concat(c("open_date").cast("string"), F.lit(" to "), F.coalesce(c("expire_date").cast("string"), F.lit("open")))
    outside = x.withColumn("name", name).filter("name IS NOT NULL").select(*issue(c("name"), level="ERROR", code=c("code"),
        trade_date=c("trade_date"), expected=life, actual=c("trade_date").cast("string")))
    unknown = bars.select("code").distinct().join(instruments.select("code"), "code", "left_anti")
    return outside.unionByName(unknown.select(*issue("DAILY_LIFECYCLE_UNKNOWN", code=c("code"), expected="an instrument", actual="none")))


def delisted_without_bars(instruments: DataFrame, bars: DataFrame, start, end) -> DataFrame:
    """Instruments that were delisted from start to end and have no bar at all."""
    gone = instruments.filter(c("expire_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(bars.select("code").distinct(),
        "code", "left_anti")
    return gone.select(*issue("DAILY_DELISTED_SYMBOL_MISSING", code=c("code"), trade_date=c("expire_date"), expected="bars before it", actual="0 rows"))


# ---- prices


def continuity(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with the close of the row before (suspended rows count, rows without a date come last) and the day's action, if any."""
    before = F.lag("close").over(Window.partitionBy("code").orderBy(c("trade_date").asc_nulls_last()))
    terms = [x for x in ("cash_dividend_per_share", "bonus_share_per_share", "capitalization_per_share", "rights_issue_per_share",
        "rights_issue_price") if x in actions.columns]
    by_day = actions.select("code", c("ex_date").alias("trade_date"), "adjustment_factor", *terms)
    return bars.select("code", "trade_date", "close", "pre_close", "suspend_flag", before.alias("previous_close")).join(by_day, ["code", "trade_date"], "left")


def pre_close_issues(chain: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    gap = F.abs(c("pre_close") - c("previous_close"))
    broken = _positive(c("previous_close")) & _positive(c("pre_close")) & c("adjustment_factor").isNull() & (
        gap > price_tolerance(c("previous_close"), tolerance))
    return chain.filter(broken).select(*issue("DAILY_PRE_CLOSE_MISMATCH", code=c("code"), trade_date=c("trade_date"), field="pre_close",
        expected=said(c("previous_close")), actual=said(c("pre_close"))))


def _events(chain: DataFrame) -> DataFrame:
    valid = _positive(c("previous_close")) & _positive(c("pre_close")) & _positive(c("adjustment_factor"))
    return chain.filter("adjustment_factor IS NOT NULL").withColumn("observed", F.when(valid, ratio(c("previous_close"), c("pre_close"))))


def adjust_audit(chain: DataFrame) -> DataFrame:
    """code, trade_date, observed ratio, declared factor and their relative deviation of each event."""
    return _events(chain).select("code", "trade_date", "observed", c("adjustment_factor").alias("declared"),
        F.abs(ratio(c("observed"), c("adjustment_factor")) - 1).alias("deviation"))


def adjust_factor_issues(chain: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Events whose factor does not give the day's pre_close; prices are compared, not ratios, as cheap stocks are rounded to cents too."""
    implied = ratio(c("previous_close"), c("adjustment_factor"))
    broken = c("observed").isNotNull() & (F.abs(implied - c("pre_close")) > price_tolerance(c("pre_close"), tolerance))
    return _events(chain).filter(broken).select(*issue("DAILY_ADJUST_FACTOR_MISMATCH", code=c("code"), trade_date=c("trade_date"),
        field="adjustment_factor", expected=said(c("observed")), actual=said(c("adjustment_factor"))))


def adjust_theory_issues(chain: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Events whose pre_close differs from the one that dividends, bonus and rights give, ten times the tolerance allowed."""
    part = lambda name: F.coalesce(finite(c(name)), F.lit(0.0))
    price = c("previous_close") - part("cash_dividend_per_share") + part("rights_issue_per_share") * part("rights_issue_price")
    theory = price / (1 + part("bonus_share_per_share") + part("capitalization_per_share") + part("rights_issue_per_share"))
    x = _events(chain).withColumn("theory", theory)
    valid = _positive(c("theory")) & _positive(c("previous_close"))
    broken = valid & (F.abs(c("theory") - c("pre_close")) > price_tolerance(c("theory"), max(10 * tolerance, 1e-3)))
    return x.filter(broken).select(*issue("DAILY_ADJUST_THEORY_MISMATCH", code=c("code"), trade_date=c("trade_date"),
        expected=said(ratio(c("previous_close"), c("theory"))), actual=said(c("observed"))))


def actions_without_bar(actions: DataFrame, bars: DataFrame, instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """Actions within a life and the audited dates whose day has no bar."""
    ends = bars.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    alive = actions.select("code", c("ex_date").alias("trade_date")).distinct().join(lives(instruments, calendar), "code").crossJoin(F.broadcast(ends))
    alive = alive.filter("trade_date BETWEEN lo AND hi AND trade_date >= open_date AND (expire_date IS NULL OR trade_date <= expire_date)").select(
        "code", "trade_date")
    gone = alive.join(bars.select("code", "trade_date").distinct(), ["code", "trade_date"], "left_anti")
    return gone.select(*issue("DAILY_CORPORATE_ACTION_WITHOUT_BAR", code=c("code"), trade_date=c("trade_date"), expected="a bar on the ex date", actual="none"))


def sessions_since_listing(bars: DataFrame, instruments: DataFrame, calendar: DataFrame, *kept: str) -> DataFrame:
    """bars with sessions: trading days since the first one on or after open_date (NULL if unknown or off the calendar); kept are columns of
    instruments to add. A bar comes once for each instrument of its code."""
    days = ordinals(calendar)
    # the first calendar day on or after each open date: a running minimum over both, latest first
    opens = instruments.filter("open_date IS NOT NULL").select(c("open_date").alias("at"), "code", F.lit(None).cast("int").alias("ordinal"))
    both = days.select(c("trade_date").alias("at"), F.lit(None).cast("string").alias("code"),
        "ordinal").unionByName(opens.select("at", F.lit(None).cast("string").alias("code"), "ordinal").distinct())
    onward = Window.orderBy(c("at").desc(), c("ordinal").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = days.agg((F.max("ordinal") + 1).alias("after"))
    found = both.withColumn("opened", F.min("ordinal").over(onward)).filter("ordinal IS NULL").crossJoin(F.broadcast(last)).select(
        c("at").alias("open_date"), F.coalesce("opened", "after").alias("opened"))
    listed = instruments.select("code", "open_date", *kept).join(found, "open_date", "left").select("code", "opened", *kept)
    return bars.join(days, "trade_date", "left").join(listed, "code", "left").withColumn("sessions", c("ordinal") - c("opened")).drop("ordinal", "opened")


def price_limit_audit(chain: DataFrame, instruments: DataFrame, calendar: DataFrame, tolerance: float = 0.005, apply_st: bool = False) -> DataFrame:
    """code, trade_date, pct_change, limit_ratio of active days without an action that moved beyond their limit."""
    valid = _active() & c("adjustment_factor").isNull() & _positive(c("previous_close")) & _positive(c("close"))
    x = sessions_since_listing(chain.filter(valid), instruments, calendar, "board", "is_st")
    limit = limit_ratio(F.coalesce("board", F.lit("unknown")), c("trade_date"), c("sessions"), c("is_st") if apply_st else None)
    x = x.select("code", "trade_date", (c("close") / c("previous_close") - 1).alias("pct_change"), limit.alias("limit_ratio"))
    return x.filter(F.abs("pct_change") > c("limit_ratio") + tolerance)


def price_limit_issues(violations: DataFrame, level: str = "WARNING") -> DataFrame:
    return violations.select(*issue("DAILY_PRICE_LIMIT_VIOLATION", level=level, code=c("code"), trade_date=c("trade_date"),
        expected=F.concat(F.lit("at most "), said(c("limit_ratio"))), actual=said(c("pct_change"))))


# ---- against minute bars


def reconcile(minute_daily: DataFrame, bars: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Full outer comparison of the codes in both: a side missing (suspended days may lack minutes), close or volume apart.

    bars may have a column multiplier (of its volume's unit).
    """
    unit = c("multiplier") if "multiplier" in bars.columns else F.lit(1.0)
    both = minute_daily.select("code").intersect(bars.select("code"))
    a = minute_daily.join(both, "code", "left_semi").select("code", "trade_date", c("close").alias("minute_close"), c("volume").alias("minute_volume"))
    b = bars.join(both, "code", "left_semi").select("code", "trade_date", c("close").alias("daily_close"), (c("volume") * unit).alias("daily_volume"),
        F.coalesce("suspend_flag", F.lit(0)).alias("flag"))
    name = (
        F.when(c("daily_close").isNull(), "CROSS_5M_MISSING_DAILY").when(c("minute_close").isNull() & (c("flag") == 0),
        "CROSS_5M_MISSING_INTRADAY").when(c("minute_close").isNull(), None)
        .when(F.abs(c("daily_close") - c("minute_close")) > tolerance * F.greatest(F.abs("daily_close"), F.lit(1e-9)), "CROSS_5M_CLOSE_MISMATCH")
        .when(F.abs(c("daily_volume") - c("minute_volume")) > tolerance * F.greatest("minute_volume", F.lit(1)), "CROSS_5M_VOLUME_MISMATCH")
    )
    x = a.join(b, ["code", "trade_date"], "full").withColumn("name", name).filter("name IS NOT NULL")
    actual = said_all(*[(k, c(k)) for k in ("daily_close", "minute_close", "daily_volume", "minute_volume")])
    return x.select(*issue(c("name"), level="WARNING", code=c("code"), trade_date=c("trade_date"), actual=actual))


@dataclass
class DailyCheck:
    """The whole audit of a store over a scope of dates and codes, rule by rule in a fixed order."""

    bars: DataFrame
    instruments: DataFrame
    calendar: DataFrame
    actions: DataFrame
    minutes: DataFrame | None = None
    codes: tuple[str, ...] = ()
    start: object = None
    end: object = None
    coverage_threshold: float = 0.95
    pre_close_tolerance: float = 1e-4
    adjust_tolerance: float = 1e-4
    limit_tolerance: float = 0.005
    limit_level: str = "WARNING"
    apply_st: bool = False
    cross_tolerance: float = 1e-3

    def __post_init__(self):
        if not 0 < self.coverage_threshold <= 1 or min(self.pre_close_tolerance, self.adjust_tolerance, self.limit_tolerance) < 0 or self.cross_tolerance <= 0:
            raise ValueError("thresholds out of range")
        if self.limit_level not in ("WARNING", "ERROR"):
            raise ValueError("limit_level is WARNING or ERROR")
        if self.start is not None and self.end is not None and str(self.start) > str(self.end):
            raise ValueError("start after end")

    def _scoped(self, df: DataFrame, date: str) -> DataFrame:
        if self.start is not None:
            df = df.filter(c(date) >= F.lit(self.start).cast("date"))
        return df if self.end is None else df.filter(c(date) <= F.lit(self.end).cast("date"))

    @cached_property
    def scoped_bars(self) -> DataFrame:
        out = self._scoped(self.bars, "trade_date")
        return out.filter(c("code").isin(sorted({x.strip().upper() for x in self.codes}))) if self.codes else out

    @cached_property
    def scoped_calendar(self) -> DataFrame:
        return effective_calendar(self._scoped(self.bars, "trade_date"), self._scoped(self.calendar, "trade_date"))

    @cached_property
    def scoped_instruments(self) -> DataFrame:
        return self.instruments.join(self.scoped_bars.select("code").distinct(), "code", "left_semi") if self.codes else self.instruments

    def parts(self) -> dict[str, DataFrame]:
        """Issues of each group of rules."""
        b, i, cal = self.scoped_bars, self.scoped_instruments, self.scoped_calendar
        unit = volume_unit(b)
        measured = b.crossJoin(F.broadcast(unit.select("multiplier")))
        expected = expected_bars(i, cal)
        chain = continuity(b, self.actions)
        ends = b.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
        gone = i.crossJoin(F.broadcast(ends)).filter("expire_date BETWEEN lo AND hi").join(b.select("code").distinct(), "code", "left_anti")
        out = {
            "scope": calendar_issues(self._scoped(self.bars, "trade_date"), self._scoped(self.calendar, "trade_date")).unionByName(instrument_issues(i)),
            "integrity": duplicate_keys(b).unionByName(rule_issues(b, integrity_rules())),
            "volume": rule_issues(measured, volume_rules(c("multiplier"))).unionByName(volume_unit_issues(unit)),
            "coverage": union(
                coverage_issues(coverage(expected, b, "trade_date"), self.coverage_threshold), missing_span_issues(missing_spans(expected, b)),
                lifecycle_issues(b, i, cal),
                gone.select(*issue("DAILY_DELISTED_SYMBOL_MISSING", code=c("code"), trade_date=c("expire_date"), expected="bars before it", actual="0 rows")),
            ),
            "prices": union(
                pre_close_issues(chain, self.pre_close_tolerance), adjust_factor_issues(chain, self.adjust_tolerance),
                adjust_theory_issues(chain, self.adjust_tolerance),
                actions_without_bar(self.actions, b, i, cal),
                price_limit_issues(price_limit_audit(chain, i, cal, self.limit_tolerance, self.apply_st), self.limit_level),
            ),
        }
        if self.minutes is not None:
            out["cross_5m"] = reconcile(self._scoped(self.minutes, "trade_date"), measured, self.cross_tolerance)
        return out

    def run(self) -> DataFrame:
        return union(*self.parts().values())


