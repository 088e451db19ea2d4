"""Queries of the store's audit, each with SQL written apart from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.limits import limit_ratio
from ..operators import daily_check as check
from ..operators import issues as issue_frames
from ..sources.driver import ticks
from ..sources.readers import read_table
from . import sql
from .base import daily, query
from .planted import ACTIONS, CALENDAR, CODE_SQL, INSTRUMENTS, STORE, actions, calendar, instruments, issue_sql, said, shown, store, store_code

c = F.col
KEY = {"code": "code", "trade_date": "trade_date"}
ACTIVE = "coalesce(suspend_flag, 0) = 0"
OHLC = f"'ohlc=' || {said('open')} || '/' || {said('high')} || '/' || {said('low')} || '/' || {said('close')}"
TURNOVER = f"'volume=' || {said('volume')} || ' amount=' || {said('amount')}"


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---- rows

INTEGRITY = [
    issue_sql("DAILY_NULL_FIELD", "ERROR", "store WHERE code IS NULL OR trade_date IS NULL OR close IS NULL", **KEY, field="'code/trade_date/close'",
    expected="'not null'", actual="'null'"),
    issue_sql("DAILY_NONPOSITIVE_PRICE", "ERROR", "store WHERE least(open, high, low, close) <= 0", **KEY, expected="'open, high, low, close > 0'",
    actual=OHLC),
    issue_sql("DAILY_OHLC_VIOLATION", "ERROR", "store WHERE high < greatest(open, close, low) OR low > least(open, close, high)", **KEY,
    expected="'low <= open, close <= high'", actual=OHLC),
    issue_sql("DAILY_NEGATIVE_QUANTITY", "ERROR", "store WHERE volume < 0 OR amount < 0", **KEY, expected="'volume, amount >= 0'", actual=TURNOVER),
    issue_sql("DAILY_INVALID_SUSPEND_FLAG", "ERROR", "store WHERE suspend_flag NOT IN (0, 1)", **KEY, expected="'0 or 1'", actual=said("suspend_flag")),
    issue_sql("DAILY_CODE_FORMAT_INVALID", "ERROR", "store WHERE code IS NOT NULL AND position('.' IN code) = 0", **KEY,
    expected="'an exchange suffix'", actual="code"),
]
query("audit_integrity_rules", sql.rounded(STORE, union_sql(INTEGRITY)))(lambda s, d: shown(check.rule_issues(store(s, d), check.integrity_rules())))

VWAP = "amount / nullif(volume, 0)"
VOLUME = [
    issue_sql("DAILY_ACTIVE_ZERO_VOLUME", "ERROR", f"store WHERE {ACTIVE} AND coalesce(volume, 0) <= 0", **KEY, field="'volume'",
    expected="'> 0 unless suspended'", actual=TURNOVER),
    issue_sql("DAILY_ACTIVE_ZERO_AMOUNT", "ERROR", f"store WHERE {ACTIVE} AND coalesce(amount, 0) <= 0 AND coalesce(volume, 0) > 0", **KEY,
    field="'amount'", expected="'> 0 unless suspended'", actual=TURNOVER),
    issue_sql("DAILY_SUSPENDED_WITH_TURNOVER", "ERROR", f"store WHERE NOT {ACTIVE} AND (coalesce(volume, 0) > 0 OR coalesce(amount, 0) > 0)", **KEY,
    expected="'0 while suspended'", actual=TURNOVER),
    issue_sql(
        "DAILY_VWAP_OUT_OF_RANGE", "WARNING",
        f"store WHERE {ACTIVE} AND volume > 0 AND amount > 0 AND low > 0 AND high > 0 AND ({VWAP} < low * 0.99 OR {VWAP} > high * 1.01)", **KEY,
        expected=f"{said('low')} || ' to ' || {said('high')}", actual=said(VWAP),
    ),
]
query("audit_volume_rules", sql.rounded(STORE, union_sql(VOLUME)))(lambda s, d: shown(check.rule_issues(store(s, d), check.volume_rules())))
DUPLICATE = issue_sql("DAILY_DUPLICATE_KEY", "ERROR", "(SELECT code, trade_date, count(*) AS n FROM ticks GROUP BY 1, 2 HAVING count(*) > 1)", **KEY,
    expected="'1 row'", actual="n::VARCHAR")
query("audit_duplicate_keys", sql.rounded([sql.TICKS], DUPLICATE))(lambda s, d: shown(check.duplicate_keys(ticks(s, d))))
UNIT = [
    "u AS (SELECT median(amount / (volume * close)) AS median FROM store WHERE coalesce(suspend_flag, 0) = 0 AND volume > 0 AND close > 0 AND amount > 0)",
    "w AS (SELECT median, abs(median - 1) AS a, abs(median / 100 - 1) AS b FROM u)",
    "unit AS (SELECT median, CASE WHEN least(a, b) > 0.2 OR a <= b THEN 1.0 ELSE 100.0 END::DOUBLE AS multiplier, coalesce(least(a, b) > 0.2, "
    "false) AS ambiguous FROM w)",
]
query("audit_volume_multiplier", sql.rounded([*STORE, *UNIT], "SELECT * FROM unit", "median multiplier"))(lambda s, d: check.volume_unit(store(s, d)))
_LOTS = [x.replace("store", "lots") if x.startswith("u AS") else x for x in UNIT]
query("audit_volume_unit_ambiguous", sql.rounded([*STORE, "lots AS (SELECT * REPLACE (amount * 30 AS amount) FROM store)", *_LOTS],
    issue_sql("DAILY_VOLUME_UNIT_AMBIGUOUS", "WARNING", "unit WHERE ambiguous", field="'volume'", expected="'near 1 or 100'", actual=said("median"))))(
    lambda s, d: shown(check.volume_unit_issues(check.volume_unit(store(s, d).withColumn("amount", c("amount") * 30))))
)

# ---- calendar, instruments, coverage

_ODD = ("(SELECT count(*) AS n, min(trade_date) AS lo, max(trade_date) AS hi FROM (SELECT DISTINCT trade_date FROM store WHERE trade_date NOT IN "
    "(SELECT trade_date FROM calendar)))")
CALENDAR_ISSUES = issue_sql("DAILY_DATE_NOT_IN_CALENDAR", "ERROR", f"{_ODD} WHERE n > 0", start_date="lo", end_date="hi",
    expected="'all dates in the calendar'", actual="n::VARCHAR")
query("audit_calendar", sql.rounded([*STORE, CALENDAR], CALENDAR_ISSUES))(lambda s, d: shown(check.calendar_issues(store(s, d), calendar(s, d))))
query("audit_calendar_unavailable",
    sql.rounded([], issue_sql("DAILY_CALENDAR_UNAVAILABLE", "ERROR", "(SELECT 1)", expected="'a trading calendar'", actual="'0 dates'")))(
    lambda s, d: shown(check.calendar_issues(store(s, d), calendar(s, d).limit(0)))
)
INSTRUMENT_ISSUES = [
    issue_sql("DAILY_OPEN_DATE_MISSING", "WARNING", "instruments WHERE open_date IS NULL", code="code", expected="'open_date'", actual="'null'"),
    issue_sql("DAILY_INVALID_LIFECYCLE_RANGE", "ERROR", "instruments WHERE expire_date < open_date", code="code",
    expected="'expire_date >= open_date'", actual="'open_date=' || open_date::VARCHAR || ' expire_date=' || expire_date::VARCHAR"),
]
_BASE = [*STORE, *INSTRUMENTS]
query("audit_instruments", sql.rounded(_BASE, union_sql(INSTRUMENT_ISSUES)))(lambda s, d: shown(check.instrument_issues(instruments(s, d))))
query("audit_no_delisted",
    sql.rounded(_BASE,
    union_sql([INSTRUMENT_ISSUES[0], issue_sql("DAILY_NO_DELISTED_SYMBOLS", "WARNING", "(SELECT count(*) AS n FROM instruments)",
    expected="'some expire_date'", actual="n::VARCHAR || ' without'")])))(
    lambda s, d: shown(check.instrument_issues(instruments(s, d).withColumn("expire_date", F.lit(None).cast("date"))))
)
EXPECTED = [
    *_BASE, CALENDAR,
    "days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ordinal FROM (SELECT DISTINCT trade_date FROM calendar))",
    "lives AS (SELECT code, coalesce(open_date, (SELECT min(trade_date) FROM calendar)) AS open_date, expire_date FROM instruments)",
    "expected AS (SELECT code, trade_date, ordinal FROM lives JOIN days ON trade_date >= open_date AND (expire_date IS NULL OR trade_date <= expire_date))",
    "held AS (SELECT e.*, s.code IS NOT NULL AS here FROM expected e LEFT JOIN (SELECT DISTINCT code, trade_date FROM store) s ON s.code = e.code AND "
    "s.trade_date = e.trade_date)",
]


def _expected(s, d) -> DataFrame:
    return check.expected_bars(instruments(s, d), calendar(s, d))


_COVER = ("SELECT {0}, count(*) AS expected_rows, count(*) FILTER (here) AS actual_rows, count(*) FILTER (NOT here) AS missing_rows, "
    "count(*) FILTER (here) / count(*)::DOUBLE AS coverage FROM held GROUP BY 1")
for _name, _key in (("date", "trade_date"), ("symbol", "code")):
    query(f"audit_coverage_{_name}", sql.rounded(EXPECTED, _COVER.format(_key), "coverage"))(lambda s, d, k=_key: check.coverage(_expected(s, d),
        store(s, d), k))
_BY_DATE = f"by_date AS ({_COVER.format('trade_date')})"
COVERAGE_ISSUES = [
    issue_sql("DAILY_COVERAGE_BELOW_THRESHOLD", "ERROR", "by_date WHERE coverage < 0.95", trade_date="trade_date", expected="'at least 0.95'",
    actual="actual_rows::VARCHAR || '/' || expected_rows::VARCHAR"),
    issue_sql("DAILY_CALENDAR_DATE_EMPTY", "ERROR", "by_date WHERE actual_rows = 0", trade_date="trade_date",
    expected="expected_rows::VARCHAR || ' rows'", actual="'0 rows'"),
]
query("audit_coverage_issues",
    sql.rounded([*EXPECTED, _BY_DATE], union_sql(COVERAGE_ISSUES)))(
    lambda s, d: shown(check.coverage_issues(check.coverage(_expected(s, d), store(s, d), "trade_date"))))
SPANS = """spans AS (SELECT code, min(trade_date) AS first_missing, max(trade_date) AS last_missing, count(*) AS days FROM (SELECT *, ordinal -
    row_number() OVER (PARTITION BY code ORDER BY ordinal) AS island
  FROM held WHERE NOT here) GROUP BY code, island)"""
SPAN_ISSUES = issue_sql("DAILY_MISSING_SPAN", "ERROR", "spans", code="code", start_date="first_missing", end_date="last_missing",
    expected="'a row a trading day'", actual="days::VARCHAR || ' days missing'")
query("audit_missing_spans", sql.rounded([*EXPECTED, SPANS], "SELECT * FROM spans"))(lambda s, d: check.missing_spans(_expected(s, d), store(s, d)))
query("audit_missing_span_issues",
    sql.rounded([*EXPECTED, SPANS], SPAN_ISSUES))(lambda s, d: shown(check.missing_span_issues(check.missing_spans(_expected(s, d), store(s, d)))))
_OUTSIDE = "(SELECT s.*, l.open_date, l.expire_date FROM store s JOIN lives l ON l.code = s.code) WHERE "
_LIFE_TEXT = "open_date::VARCHAR || ' to ' || coalesce(expire_date::VARCHAR, 'open')"
LIFECYCLE_ISSUES = [
    issue_sql("DAILY_DATA_BEFORE_LISTING", "ERROR", _OUTSIDE + "trade_date < open_date AND coalesce(suspend_flag, 0) <> 1", **KEY,
    expected=_LIFE_TEXT, actual="trade_date::VARCHAR"),
    issue_sql("DAILY_DATA_AFTER_DELISTING", "ERROR", _OUTSIDE + "trade_date > expire_date AND NOT (trade_date < open_date AND coalesce(suspend_flag, "
    "0) <> 1)", **KEY, expected=_LIFE_TEXT, actual="trade_date::VARCHAR"),
    issue_sql("DAILY_LIFECYCLE_UNKNOWN", "WARNING", "(SELECT DISTINCT code FROM store WHERE code NOT IN (SELECT code FROM instruments))", code="code",
    expected="'an instrument'", actual="'none'"),
]
query("audit_lifecycle",
    sql.rounded(EXPECTED, union_sql(LIFECYCLE_ISSUES)))(lambda s, d: shown(check.lifecycle_issues(store(s, d), instruments(s, d), calendar(s, d))))
_LATE = "store WHERE trade_date > DATE '2024-01-28'"
query("audit_delisted_without_bars", sql.rounded(_BASE, issue_sql(
    "DAILY_DELISTED_SYMBOL_MISSING", "WARNING",
    f"instruments WHERE expire_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-25' AND code NOT IN (SELECT code FROM {_LATE})", code="code",
    trade_date="expire_date", expected="'bars before it'", actual="'0 rows'")))(
    lambda s, d: shown(check.delisted_without_bars(instruments(s, d), store(s, d).filter("trade_date > DATE '2024-01-28'"), "2024-01-10", "2024-01-25"))
)

# ---- prices

CHAIN = [
    *EXPECTED, ACTIONS,
    """chain AS (SELECT o.*, a.adjustment_factor, a.cash, a.bonus, a.rights, a.price FROM (SELECT code, trade_date, close, pre_close, suspend_flag,
    lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS previous_close FROM store) o
      LEFT JOIN actions a ON a.code = o.code AND a.ex_date = o.trade_date)""",
    "events_of AS (SELECT *, CASE WHEN previous_close > 0 AND pre_close > 0 AND adjustment_factor > 0 THEN previous_close / pre_close END AS observed "
    "FROM chain WHERE adjustment_factor IS NOT NULL)",
    "theory_of AS (SELECT *, (previous_close - cash + rights * price) / (1 + bonus + rights) AS theory FROM events_of)",
]


def _chain(s, d) -> DataFrame:
    return check.continuity(store(s, d), actions(s, d))


PRE_CLOSE = issue_sql("DAILY_PRE_CLOSE_MISMATCH", "ERROR",
    "chain WHERE previous_close > 0 AND pre_close > 0 AND adjustment_factor IS NULL AND abs(pre_close - previous_close) > 0.01 + 0.0001 * "
    "abs(previous_close)", **KEY, field="'pre_close'", expected=said("previous_close"), actual=said("pre_close"))
FACTOR = issue_sql("DAILY_ADJUST_FACTOR_MISMATCH", "ERROR",
    "events_of WHERE observed IS NOT NULL AND abs(previous_close / adjustment_factor - pre_close) > 0.01 + 0.0001 * abs(pre_close)", **KEY,
    field="'adjustment_factor'", expected=said("observed"), actual=said("adjustment_factor"))
THEORY = issue_sql("DAILY_ADJUST_THEORY_MISMATCH", "WARNING",
    "theory_of WHERE theory > 0 AND previous_close > 0 AND abs(theory - pre_close) > 0.01 + 0.001 * abs(theory)", **KEY,
    expected=said("previous_close / theory"), actual=said("observed"))
_HELD = ("(SELECT a.code, a.ex_date FROM actions a JOIN lives l ON l.code = a.code WHERE a.ex_date BETWEEN (SELECT min(trade_date) FROM {0}) AND "
    "(SELECT max(trade_date) FROM {0}) AND a.ex_date >= l.open_date AND (l.expire_date IS NULL OR a.ex_date <= l.expire_date) AND NOT EXISTS (SELECT "
    "1 FROM {0} b WHERE b.code = a.code AND b.trade_date = a.ex_date))")
NO_BAR = issue_sql("DAILY_CORPORATE_ACTION_WITHOUT_BAR", "WARNING", "{0}", code="code", trade_date="ex_date", expected="'a bar on the ex date'",
    actual="'none'")
query("audit_pre_close", sql.rounded(CHAIN, PRE_CLOSE))(lambda s, d: shown(check.pre_close_issues(_chain(s, d))))
query("audit_adjust_audit",
    sql.rounded(CHAIN, "SELECT code, trade_date, observed, adjustment_factor AS declared, abs(observed / adjustment_factor - 1) AS deviation FROM "
    "events_of", "observed declared deviation"))(lambda s, d: check.adjust_audit(_chain(s, d)))
query("audit_adjust_factor", sql.rounded(CHAIN, FACTOR))(lambda s, d: shown(check.adjust_factor_issues(_chain(s, d))))
query("audit_adjust_theory", sql.rounded(CHAIN, THEORY))(lambda s, d: shown(check.adjust_theory_issues(_chain(s, d))))
query("audit_action_without_bar", sql.rounded([*CHAIN, "busy AS (SELECT * FROM store WHERE volume > 40)"], NO_BAR.format(_HELD.format("busy"))))(
    lambda s, d: shown(check.actions_without_bar(actions(s, d), store(s, d).filter("volume > 40"), instruments(s, d), calendar(s, d)))
)
LIMITS = [
    "aged AS (SELECT t.*, i.board, i.is_st, dd.ordinal - CASE WHEN i.open_date IS NOT NULL THEN (SELECT count(*) FROM days x WHERE x.trade_date < "
    "i.open_date) + 1 END AS sessions FROM chain t LEFT JOIN instruments i ON i.code = t.code LEFT JOIN days dd ON dd.trade_date = t.trade_date WHERE "
    "coalesce(t.suspend_flag, 0) = 0 AND t.adjustment_factor IS NULL AND t.previous_close > 0 AND t.close > 0)",
    "limited AS (SELECT code, trade_date, close / previous_close - 1 AS pct_change, CASE board WHEN 'star' THEN CASE WHEN coalesce(sessions BETWEEN 0 "
    "AND 4, false) THEN NULL ELSE 0.2 END WHEN 'chinext' THEN CASE WHEN coalesce(sessions BETWEEN 0 AND 4, false) THEN NULL ELSE 0.2 END WHEN 'bse' "
    "THEN CASE WHEN coalesce(sessions = 0, false) THEN NULL ELSE 0.3 END WHEN 'main' THEN CASE WHEN coalesce(sessions = 0, false) THEN NULL ELSE 0.1 "
    "END END::DOUBLE AS limit_ratio FROM aged)",
    "beyond AS (SELECT * FROM limited WHERE abs(pct_change) > limit_ratio + 0.005)",
]
LIMIT_ISSUES = issue_sql("DAILY_PRICE_LIMIT_VIOLATION", "WARNING", "beyond", **KEY, expected=f"'at most ' || {said('limit_ratio')}", actual=said("pct_change"))
query("audit_price_limit_violations", sql.rounded([*CHAIN, *LIMITS], "SELECT * FROM beyond", "pct_change limit_ratio"))(
    lambda s, d: check.price_limit_audit(_chain(s, d), instruments(s, d), calendar(s, d)))
query("audit_price_limits",
    sql.rounded([*CHAIN, *LIMITS], LIMIT_ISSUES))(
    lambda s, d: shown(check.price_limit_issues(check.price_limit_audit(_chain(s, d), instruments(s, d), calendar(s, d)))))


def _limit_cases(s, d) -> DataFrame:
    """Every board, years around the changes, ages around the waived sessions, warned or not."""
    k = c("o_orderkey")
    o = read_table(s, d, "orders").select(
        k, F.element_at(F.array(*map(F.lit, ("star", "main", "chinext", "bse", "unknown"))), (k % 5 + 1).cast("int")).alias("board"),
        F.date_add(F.lit("2018-01-01").cast("date"), (k % 1500).cast("int")).alias("day"),
        F.when(k % 11 != 10, (k % 11 - 2).cast("int")).alias("sessions"), (k % 3 == 0).alias("is_st"),
    )
    plain = limit_ratio(c("board"), c("day"), c("sessions"))
    return o.select("o_orderkey", plain.alias("limit_ratio"), limit_ratio(c("board"), c("day"), c("sessions"), c("is_st")).alias("st_limit_ratio"))


_RATIO = """CASE board WHEN 'star' THEN CASE WHEN day < DATE '2019-07-22' OR coalesce(sessions BETWEEN 0 AND 4, false) THEN NULL ELSE 0.2 END
  WHEN 'chinext' THEN CASE WHEN day < DATE '2020-08-24' THEN CASE WHEN coalesce(sessions = 0, false) THEN NULL ELSE {0} END WHEN coalesce(sessions
  BETWEEN 0 AND 4, false) THEN NULL ELSE 0.2 END
  WHEN 'bse' THEN CASE WHEN coalesce(sessions = 0, false) THEN NULL ELSE 0.3 END WHEN 'main' THEN CASE WHEN coalesce(sessions = 0, false) THEN NULL
  ELSE {0} END END::DOUBLE"""
query("limit_ratio_rules",
    sql.rounded(
    ["k AS (SELECT o_orderkey, ['star', 'main', 'chinext', 'bse', 'unknown'][o_orderkey % 5 + 1] AS board, (DATE '2018-01-01' + (o_orderkey % "
    "1500)::INT)::DATE AS day, CASE WHEN o_orderkey % 11 <> 10 THEN o_orderkey % 11 - 2 END AS sessions, o_orderkey % 3 = 0 AS is_st FROM orders)"],
      f"SELECT o_orderkey, {_RATIO.format('0.1')} AS limit_ratio, {_RATIO.format('CASE WHEN is_st THEN 0.05 ELSE 0.1 END')} AS st_limit_ratio FROM k",
      "limit_ratio st_limit_ratio"))(_limit_cases)

# ---- against minute bars, and the whole


def _minutes(s, d) -> DataFrame:
    """Daily sums of minutes: some codes' days missing, closes and volumes off."""
    v = c("volume")
    x = daily(s, d).filter(v % 6 != 0)
    return x.select(store_code().alias("code"), "trade_date", F.when(v % 8 == 0, c("close") * 1.01).otherwise(c("close")).alias("close"),
        F.when(v % 9 == 0, v + 1).otherwise(v).cast("double").alias("volume"))


MINUTES = (f"minutes AS (SELECT {CODE_SQL} AS code, trade_date, CASE WHEN volume % 8 = 0 THEN close * 1.01 ELSE close END AS close, "
    f"(CASE WHEN volume % 9 = 0 THEN volume + 1 ELSE volume END)::DOUBLE AS volume FROM daily WHERE volume % 6 <> 0)")
CROSS = [
    MINUTES,
    "overlap AS (SELECT code FROM store INTERSECT SELECT code FROM minutes)",
    """both_sides AS (SELECT coalesce(b.code, m.code) AS code, coalesce(b.trade_date, m.trade_date) AS trade_date, b.close AS dc, m.close AS mc,
    b.volume AS dv, m.volume AS mv, coalesce(b.suspend_flag, 0) AS flag
      FROM store b FULL JOIN minutes m ON m.code = b.code AND m.trade_date = b.trade_date WHERE coalesce(b.code, m.code) IN (SELECT code FROM overlap))""",
    """named AS (SELECT *, CASE WHEN dc IS NULL THEN 'CROSS_5M_MISSING_DAILY' WHEN mc IS NULL AND flag = 0 THEN 'CROSS_5M_MISSING_INTRADAY' WHEN mc
    IS NULL THEN NULL WHEN abs(dc - mc) > 0.001 * greatest(abs(dc), 1e-9) THEN 'CROSS_5M_CLOSE_MISMATCH'
      WHEN abs(dv - mv) > 0.001 * greatest(mv, 1) THEN 'CROSS_5M_VOLUME_MISMATCH' END AS name FROM both_sides)""",
]
CROSS_ISSUES = issue_sql("(name)", "WARNING", "named WHERE name IS NOT NULL", **KEY,
    actual=f"'daily_close=' || {said('dc')} || ' minute_close=' || {said('mc')} || ' daily_volume=' || {said('dv')} || ' minute_volume=' || {said('mv')}")
query("audit_reconcile_5m", sql.rounded([*STORE, *CROSS], CROSS_ISSUES))(lambda s, d: shown(check.reconcile(_minutes(s, d), store(s, d))))
_DELISTED = issue_sql("DAILY_DELISTED_SYMBOL_MISSING", "WARNING",
    "instruments WHERE expire_date BETWEEN (SELECT min(trade_date) FROM store) AND (SELECT max(trade_date) FROM store) AND code NOT IN (SELECT code "
    "FROM store)", code="code", trade_date="expire_date", expected="'bars before it'", actual="'0 rows'")
_ALL = [
    CALENDAR_ISSUES, *INSTRUMENT_ISSUES, *INTEGRITY, *VOLUME, *COVERAGE_ISSUES, SPAN_ISSUES, *LIFECYCLE_ISSUES, _DELISTED, PRE_CLOSE, FACTOR, THEORY,
    NO_BAR.format(_HELD.format("store")), LIMIT_ISSUES, CROSS_ISSUES,
]
_EVERYTHING = [*CHAIN, _BY_DATE, SPANS, *LIMITS, *CROSS, f"issues AS ({union_sql(_ALL)})"]


def _whole(s, d) -> DataFrame:
    return check.DailyCheck(store(s, d), instruments(s, d), calendar(s, d), actions(s, d), _minutes(s, d)).run()


query("audit_summary",
    sql.rounded(_EVERYTHING, "SELECT level, issue_code, count(*) AS n, count(DISTINCT code) AS n_codes FROM issues GROUP BY 1, 2"))(
    lambda s, d: issue_frames.summary(_whole(s, d)))
query("audit_status",
    sql.rounded(_EVERYTHING,
    "SELECT 'failed' AS status, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARNING') AS warnings, count(*) FILTER (level "
    "= 'INFO') AS info FROM issues"))(
    lambda s, d: issue_frames.status(_whole(s, d))
)
query("audit_samples",
    sql.rounded([*STORE, f"issues AS ({union_sql(INTEGRITY)})"],
    "SELECT issue_code, code, trade_date, row_number() OVER (PARTITION BY issue_code ORDER BY code, trade_date) AS place, count(*) OVER (PARTITION BY "
    "issue_code) AS total FROM issues QUALIFY place <= 5"))(
    lambda s, d: issue_frames.samples(check.rule_issues(store(s, d), check.integrity_rules()), 5).select("issue_code", "code", "trade_date", "place", "total")
)
_CARRIED = "code IN (SELECT code FROM instruments WHERE is_st) AND issue_code IN ('DAILY_NULL_FIELD', 'DAILY_OHLC_VIOLATION')"
query("audit_downgrade",
    sql.rounded([*_BASE, f"issues AS ({union_sql(INTEGRITY)})"],
    f"SELECT issue_code, CASE WHEN {_CARRIED} THEN 'INFO' ELSE level END AS level, code, trade_date FROM issues"))(
    lambda s, d: issue_frames.downgrade(check.rule_issues(store(s, d), check.integrity_rules()), ["DAILY_NULL_FIELD", "DAILY_OHLC_VIOLATION"],
    instruments(s, d).filter("is_st")).select("issue_code", "level", "code", "trade_date")
)
