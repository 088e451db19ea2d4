"""Queries of the landing-zone audit over planted text rows, each with SQL written apart from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import issues as issue_frames
from ..operators import self_check as check
from . import sql
from .base import SPLIT, daily, query
from .daily_check import KEY, union_sql
from .planted import issue_sql, said, shown

c = F.col
NUMBERS = ["open", "high", "low", "close", "pre_close", "volume", "amount", "suspend_flag"]


def landed_once(s, d) -> DataFrame:
    """Landing rows, all text: a partition per date, some rows wrong in every way, none landed twice."""
    v = c("volume")
    hit = lambda k: v % k == 0
    text = lambda x: x.cast("decimal(24,4)").cast("string")
    price = issue_frames.four_decimals
    before = F.lag("close").over(Window.partitionBy("code").orderBy(c("trade_date").asc_nulls_last()))
    part = F.date_format("trade_date", "yyyyMMdd")
    return daily(s, d).withColumn("before", before).select(
        part.alias("partition_date"),
        F.when(hit(59), "").when(hit(61), "OUT").otherwise(F.concat(F.lit(" c"), "code")).alias("code"),
        F.when(hit(67), "20240101").otherwise(part).alias("trade_date"),
        price(c("open")).alias("open"),
        F.when(hit(13), price(c("low") * 0.9)).otherwise(price(c("high"))).alias("high"),
        price(c("low")).alias("low"),
        F.when(hit(37), "n/a").otherwise(price(c("close"))).alias("close"),
        price(F.coalesce(F.when(hit(7), 2.5).when(hit(5), 1.01).otherwise(1.0) * c("before"), c("close"))).alias("pre_close"),
        F.when(hit(17), "0").when(hit(41), text(-v)).when(hit(19), "inf").when(hit(47), text(v * 900)).otherwise(text(v)).alias("volume"),
        F.when(hit(23), "0").otherwise(price(c("close") * v)).alias("amount"),
        F.when(hit(11), "1").when(hit(29), "2").otherwise("0").alias("suspend_flag"),
        F.concat(F.lit("date="), part, F.lit("/data.csv")).alias("source_file"),
        v.alias("source_row"),
    )


def landed(s, d) -> DataFrame:
    """landed_once(), some of its rows twice."""
    x = landed_once(s, d)
    return x.unionByName(x.filter(c("source_row") % 43 == 0))


_T = "CAST({0} AS DECIMAL(24,4))::VARCHAR"
_DAY = "strftime(trade_date, '%Y%m%d')"
LANDED = [
    sql.TICKS, sql.DAILY_BARS,
    f"""one AS (SELECT {_DAY} AS partition_date,
      CASE WHEN volume % 59 = 0 THEN '' WHEN volume % 61 = 0 THEN 'OUT' ELSE ' c' || code END AS code,
      CASE WHEN volume % 67 = 0 THEN '20240101' ELSE {_DAY} END AS trade_date,
      {_T.format('open')} AS open,
      CASE WHEN volume % 13 = 0 THEN {_T.format('low * 0.9')} ELSE {_T.format('high')} END AS high,
      {_T.format('low')} AS low,
      CASE WHEN volume % 37 = 0 THEN 'n/a' ELSE {_T.format('close')} END AS close,
      {_T.format('coalesce(CASE WHEN volume % 7 = 0 THEN 2.5::DOUBLE WHEN volume % 5 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END * before, close)')}
      AS pre_close,
      CASE WHEN volume % 17 = 0 THEN '0' WHEN volume % 41 = 0 THEN {_T.format('-volume')} WHEN volume % 19 = 0 THEN 'inf' WHEN volume % 47 = 0 THEN
      {_T.format('volume * 900')} ELSE {_T.format('volume')} END AS volume,
      CASE WHEN volume % 23 = 0 THEN '0' ELSE {_T.format('close * volume')} END AS amount,
      CASE WHEN volume % 11 = 0 THEN '1' WHEN volume % 29 = 0 THEN '2' ELSE '0' END AS suspend_flag,
      'date=' || {_DAY} || '/data.csv' AS source_file, volume AS source_row
      FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS before FROM daily))""",
    "landed AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE source_row % 43 = 0)",
]


def landed_instruments(s, d) -> DataFrame:
    """Lives as landed text: sentinels, unparsable and reversed dates, repeated codes."""
    n = c("code").cast("long")
    first = daily(s, d).groupBy("code").agg(F.min("trade_date").alias("first"))
    x = first.select(
        F.concat(F.lit("c"), "code").alias("code"),
        F.when(n % 13 == 0, "0").when(n % 17 == 0, "2024-13-45").otherwise(F.date_format(F.date_add("first", F.when(n % 7 == 0, 3).otherwise(0)),
        "yyyyMMdd")).alias("open_date"),
        F.when(n % 11 == 0, "20231201").when(n % 6 == 0, F.lit(SPLIT.strftime("%Y%m%d"))).when(n % 19 == 0, "soon").otherwise("99999999").alias("expire_date"),
        n.alias("seq"),
    )
    kept = x.filter(c("seq") % 10 != 0)
    return kept.unionByName(kept.filter(c("seq") % 23 == 0).withColumn("seq", c("seq") + 1000))


LANDED_LIVES = [
    f"""info AS (SELECT 'c' || code AS code, CASE WHEN n % 13 = 0 THEN '0' WHEN n % 17 = 0 THEN '2024-13-45' ELSE strftime(first + CASE WHEN n % 7 =
    0 THEN 3 ELSE 0 END, '%Y%m%d') END AS open_date,
      CASE WHEN n % 11 = 0 THEN '20231201' WHEN n % 6 = 0 THEN '{SPLIT:%Y%m%d}' WHEN n % 19 = 0 THEN 'soon' ELSE '99999999' END AS expire_date, n AS seq
      FROM (SELECT code, code::BIGINT AS n, min(trade_date) AS first FROM daily GROUP BY code) WHERE n % 10 <> 0)""",
    "info2 AS (SELECT * FROM info UNION ALL SELECT * REPLACE (seq + 1000 AS seq) FROM info WHERE seq % 23 = 0)",
    "cal AS (SELECT DISTINCT trade_date FROM daily WHERE day(trade_date) <> 7 UNION ALL SELECT DATE '2024-02-05')",
    """life0 AS (SELECT upper(code) AS code, seq, open_date AS r_open, expire_date AS r_expire, try_strptime(CASE WHEN open_date <> '0' THEN
    left(regexp_replace(open_date, '[^0-9]', '', 'g'), 8) END, '%Y%m%d')::DATE AS o,
      try_strptime(CASE WHEN expire_date NOT IN ('99999999', 'soon') THEN expire_date END, '%Y%m%d')::DATE AS x FROM info2)""",
    """lif AS (SELECT code, seq, r_open, r_expire, coalesce(o, (SELECT min(trade_date) FROM cal)) AS open_date, x AS expire_date, o IS NULL AS
    open_missing, o IS NULL AND r_open <> '0' AS open_invalid, r_expire = 'soon' AS expire_invalid,
      row_number() OVER (PARTITION BY code ORDER BY seq) AS place, count(*) OVER (PARTITION BY code) AS times FROM life0)""",
]


def landed_calendar(s, d) -> DataFrame:
    return daily(s, d).select("trade_date").distinct().filter(F.dayofmonth("trade_date") != 7).unionByName(s.sql("SELECT DATE '2024-02-05' AS trade_date"))


def landed_actions(s, d) -> DataFrame:
    return daily(s, d).filter(c("volume") % 3 == 0).select(F.concat(F.lit("C"), "code").alias("code"), c("trade_date").alias("ex_date"))


def symbols(s, d) -> DataFrame:
    return daily(s, d).select(F.concat(F.lit("C"), "code").alias("code")).distinct()


def _life(s, d) -> DataFrame:
    return check.lifecycle(landed_instruments(s, d), landed_calendar(s, d))


def _placed(s, d) -> DataFrame:
    return check.placed(check.prepared(landed(s, d)), symbols(s, d), _life(s, d))


BASE = [*LANDED, *LANDED_LIVES]
LIFE_ISSUES = [
    issue_sql("INSTRUMENT_INFO_DUPLICATE", "ERROR", "lif WHERE times > 1", code="code", expected="'one row a code'", actual="times::VARCHAR"),
    issue_sql("OPEN_DATE_INVALID", "ERROR", "lif WHERE place = 1 AND open_invalid", code="code", field="'open_date'", actual="r_open"),
    issue_sql("EXPIRE_DATE_INVALID", "ERROR", "lif WHERE place = 1 AND expire_invalid", code="code", field="'expire_date'", actual="r_expire"),
    issue_sql("OPEN_DATE_MISSING", "INFO", "lif WHERE place = 1 AND open_missing", code="code", field="'open_date'", actual="r_open"),
    issue_sql("INVALID_LIFECYCLE_RANGE", "ERROR", "lif WHERE place = 1 AND open_date > expire_date", code="code", field="'open_date,expire_date'",
    actual="open_date::VARCHAR || ' > ' || expire_date::VARCHAR"),
]
query("selfcheck_lifecycle", sql.rounded(BASE, union_sql(LIFE_ISSUES)))(lambda s, d: shown(check.lifecycle_issues(_life(s, d))))
SCOPE_ISSUES = [issue_sql("SYMBOLS_MISSING_INSTRUMENT_INFO", "ERROR",
    "(SELECT count(DISTINCT code) AS n FROM daily WHERE code::BIGINT % 10 = 0) WHERE n > 0", actual="n::VARCHAR")]
query("selfcheck_scope", sql.rounded(BASE, union_sql(SCOPE_ISSUES)))(lambda s, d: shown(check.scope_issues(symbols(s, d), landed_instruments(s, d))))
query("selfcheck_scope_extra",
    sql.rounded(BASE,
    issue_sql("INSTRUMENT_INFO_OUTSIDE_SCOPE", "WARNING", "(SELECT count(DISTINCT code) AS n FROM info2 WHERE seq % 1000 > 20) WHERE n > 0",
    actual="n::VARCHAR")))(
    # numbers repeat by the thousand, as those of landed_instruments' second rows
    lambda s, d: shown(check.scope_issues(symbols(s, d).filter("substring(code, 2)::bigint % 1000 <= 20 AND substring(code, 2)::bigint % 10 <> 0"),
    landed_instruments(s, d)))
)
query("selfcheck_scope_empty", sql.rounded([], issue_sql("EXPECTED_SYMBOLS_EMPTY", "ERROR", "(SELECT 1)", actual="'0'")))(
    lambda s, d: shown(check.scope_issues(symbols(s, d).limit(0), landed_instruments(s, d).limit(0)))
)
_NUM = "CASE WHEN isfinite(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END"
PLACED = [
    *BASE,
    f"""num AS (SELECT upper(trim(code)) AS code, partition_date, trade_date AS raw_date, strptime(partition_date, '%Y%m%d')::DATE AS trade_date,
    {', '.join(f'{_NUM.format(n)} AS {n}, {n} AS r_{n}' for n in NUMBERS)}, source_file, source_row FROM landed)""",
    """plc AS (SELECT n.*, coalesce(l.open_date, n.trade_date) AS open_date, l.expire_date, CASE WHEN n.code = '' THEN 'KLINE_CODE_MISSING' WHEN
    n.code NOT IN (SELECT 'C' || code FROM daily) THEN 'KLINE_SYMBOL_OUTSIDE_SCOPE'
      WHEN n.raw_date <> n.partition_date THEN 'KLINE_DATE_PARTITION_MISMATCH' END AS problem FROM num n LEFT JOIN lif l ON l.code = n.code AND l.place = 1)""",
    "alv AS (SELECT * FROM plc WHERE problem IS NULL AND trade_date >= open_date AND (expire_date IS NULL OR trade_date <= expire_date))",
    "jdg AS (SELECT * FROM alv WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in NUMBERS) + ")",
]
_OHLC = "'open=' || " + " || ".join(f"{said(n)}" + (f" || ' {m}='" if m else "") for n, m in (("open", "high"), ("high", "low"), ("low", "close"),
    ("close", "")))
_TURN = f"'volume=' || {said('volume')} || ' amount=' || {said('amount')}"
ROW_ISSUES = [
    issue_sql("(problem)", "ERROR", "plc WHERE problem IS NOT NULL", **KEY,
    field="CASE WHEN problem = 'KLINE_DATE_PARTITION_MISMATCH' THEN 'trade_date' ELSE 'code' END",
    actual="CASE WHEN problem = 'KLINE_DATE_PARTITION_MISMATCH' THEN raw_date ELSE code END"),
    *[issue_sql("KLINE_FIELD_INVALID", "ERROR", f"alv WHERE {n} IS NULL", **KEY, field=f"'{n}'", expected="'a finite number'", actual=f"r_{n}")
    for n in NUMBERS],
    issue_sql("INVALID_OHLC_RELATION", "ERROR", "jdg WHERE high < greatest(open, low, close) OR low > least(open, high, close)", **KEY,
    field="'open,high,low,close'", actual=_OHLC),
    issue_sql("NEGATIVE_TURNOVER", "ERROR", "jdg WHERE volume < 0 OR amount < 0", **KEY, field="'volume,amount'", actual=_TURN),
    issue_sql("INVALID_SUSPEND_FLAG", "ERROR", "jdg WHERE suspend_flag NOT IN (0, 1)", **KEY, field="'suspend_flag'", actual=said("suspend_flag")),
    issue_sql("ACTIVE_ZERO_VOLUME", "ERROR", "jdg WHERE suspend_flag = 0 AND volume <= 0", **KEY, field="'volume'", actual=_TURN),
    issue_sql("ACTIVE_ZERO_AMOUNT", "ERROR", "jdg WHERE suspend_flag = 0 AND amount <= 0", **KEY, field="'amount'", actual=_TURN),
    issue_sql("SUSPENDED_WITH_TURNOVER", "ERROR", "jdg WHERE suspend_flag = 1 AND (volume <> 0 OR amount <> 0)", **KEY,
    field="'suspend_flag,volume,amount'", actual=_TURN),
    issue_sql("SUSPENDED_PRICE_NOT_FLAT", "WARNING", "jdg WHERE suspend_flag = 1 AND NOT (open = high AND high = low AND low = close)", **KEY,
    field="'open,high,low,close'", actual=_OHLC),
]
query("selfcheck_rows", sql.rounded(PLACED, union_sql(ROW_ISSUES)))(lambda s, d: shown(check.row_issues(_placed(s, d))))
DUPLICATES = issue_sql("KLINE_DUPLICATE_KEY", "ERROR",
    "(SELECT *, count(*) OVER (PARTITION BY partition_date, code, raw_date) AS times FROM num) WHERE times > 1", **KEY, field="'code,trade_date'",
    expected="'one row'")
query("selfcheck_duplicates", sql.rounded(PLACED, DUPLICATES))(lambda s, d: shown(check.duplicate_issues(check.prepared(landed(s, d)))))
_SIDE = ("(SELECT code, name, min(trade_date) AS trade_date, min(lim) AS lim FROM (SELECT code, trade_date, CASE WHEN trade_date < open_date AND "
    "coalesce(suspend_flag, 0) <> 1 THEN 'DATA_BEFORE_LISTING' WHEN trade_date > expire_date THEN 'DATA_AFTER_DELISTING' END AS name, "
    "CASE WHEN trade_date < open_date AND coalesce(suspend_flag, 0) <> 1 THEN open_date ELSE expire_date END AS lim FROM plc WHERE problem IS NULL) "
    "WHERE name IS NOT NULL GROUP BY 1, 2)")
OUTSIDE = issue_sql("(name)", "ERROR", _SIDE, **KEY, field="'trade_date'", expected="lim::VARCHAR", actual="trade_date::VARCHAR")
query("selfcheck_outside_life", sql.rounded(PLACED, OUTSIDE))(lambda s, d: shown(check.outside_life_issues(_placed(s, d))))
CONTINUED = [
    "cnt AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date, source_file, source_row) AS before, EXISTS (SELECT 1 FROM daily a "
    "WHERE 'C' || a.code = alv.code AND a.trade_date = alv.trade_date AND a.volume % 3 = 0) AS explained FROM alv)",
    "vol AS (SELECT *, count(*) OVER w AS n, quantile_cont(volume, 0.5) OVER w AS median FROM alv WHERE volume > 0 AND suspend_flag = 0 WINDOW w AS "
    "(PARTITION BY code ORDER BY trade_date, source_file, source_row ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))",
]
CONTINUITY = [
    issue_sql("(CASE WHEN explained THEN 'PRE_CLOSE_DISCONTINUITY_EXPLAINED' ELSE 'PRE_CLOSE_DISCONTINUITY' END)", "INFO",
    "cnt WHERE pre_close <> 0 AND before <> 0 AND abs(pre_close / before - 1) > 1e-6", **KEY, field="'pre_close'", expected=said("before"),
    actual=said("pre_close")),
    issue_sql("ABNORMAL_PRICE_JUMP", "WARNING", "alv WHERE close <> 0 AND pre_close <> 0 AND abs(close / pre_close - 1) > 0.5", **KEY,
    field="'close,pre_close'", actual=said("close / pre_close - 1")),
    issue_sql("ABNORMAL_VOLUME_SCALE", "WARNING", "vol WHERE n >= 10 AND greatest(volume / median, median / volume) >= 100", **KEY, field="'volume'",
    expected=said("median"), actual=said("volume")),
]
# rows landed twice tie in the running order; the audit of order-dependent rules sees each once. Rows of different codes may be equal where
# the code is missing, so that distinct() would drop rows.
_ONCE = [x.replace("landed AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE source_row % 43 = 0)", "landed AS (SELECT * FROM one)") for x in PLACED]


def _placed_once(s, d) -> DataFrame:
    return check.placed(check.prepared(landed_once(s, d)), symbols(s, d), _life(s, d))


query("selfcheck_continuity",
    sql.rounded([*_ONCE, *CONTINUED], union_sql(CONTINUITY)))(lambda s, d: shown(check.continuity_issues(_placed_once(s, d), landed_actions(s, d))))
SCAN = [
    "dys AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ordinal FROM cal)",
    "liv AS (SELECT s.code, coalesce(l.open_date, (SELECT min(trade_date) FROM cal)) AS open_date, l.expire_date FROM (SELECT DISTINCT 'C' || code AS "
    "code FROM daily) s LEFT JOIN lif l ON l.code = s.code AND l.place = 1)",
    "xpt AS (SELECT code, trade_date, ordinal FROM liv JOIN dys ON trade_date >= open_date AND (expire_date IS NULL OR trade_date <= expire_date))",
    "hld AS (SELECT e.*, p.code IS NOT NULL AS here FROM xpt e LEFT JOIN (SELECT DISTINCT code, trade_date FROM plc WHERE problem IS NULL) p ON "
    "p.code = e.code AND p.trade_date = e.trade_date)",
    "dte AS (SELECT trade_date, count(*) AS expected, count(*) FILTER (here) AS actual FROM hld GROUP BY 1)",
    "gap AS (SELECT code, min(trade_date) AS a, max(trade_date) AS z, count(*) AS days FROM (SELECT *, ordinal - row_number() OVER (PARTITION BY code "
    "ORDER BY ordinal) AS island FROM hld WHERE NOT here) GROUP BY code, island)",
    "sym AS (SELECT code, count(*) AS expected, count(*) FILTER (here) AS actual, min(trade_date) AS a, max(trade_date) AS z FROM hld GROUP BY 1)",
]
_SHARE = "actual::VARCHAR || '/' || expected::VARCHAR"
SCAN_ISSUES = [
    issue_sql("MISSING_DATE_PARTITION", "ERROR", "cal WHERE trade_date NOT IN (SELECT trade_date FROM num)", trade_date="trade_date"),
    issue_sql("DATA_ON_NON_TRADING_DATE", "ERROR", "(SELECT DISTINCT trade_date FROM num) WHERE trade_date NOT IN (SELECT trade_date FROM cal)",
    trade_date="trade_date"),
    issue_sql("DATE_SYMBOLS_MISSING", "ERROR", "dte WHERE actual < expected", trade_date="trade_date", actual=_SHARE),
    issue_sql("LOW_DATE_COVERAGE", "ERROR", "dte WHERE actual / expected::DOUBLE < 0.95", trade_date="trade_date", actual=_SHARE),
    issue_sql("KLINE_MISSING_SPAN", "ERROR", "gap", code="code", start_date="a", end_date="z", expected="'a row a trading day'",
    actual="days::VARCHAR || ' days missing'"),
    issue_sql("SYMBOL_ALL_DATA_MISSING", "ERROR", "sym WHERE actual = 0", code="code", start_date="a", end_date="z", expected="expected::VARCHAR",
    actual="'0'"),
]
query("selfcheck_scan", sql.rounded([*PLACED, *SCAN], union_sql(SCAN_ISSUES)))(
    lambda s, d: shown(check.scan_issues(_placed(s, d), check.prepared(landed(s, d)).select("part_date"), _life(s, d), symbols(s, d), landed_calendar(s, d)))
)
query("selfcheck_symbol_statistics", sql.rounded([*PLACED, *SCAN], """SELECT s.code, expected AS expected_rows, actual AS actual_rows, expected -
    actual AS missing_rows, actual / expected::DOUBLE AS coverage,
  (SELECT count(*) FROM alv a WHERE a.code = s.code AND suspend_flag = 1) AS suspended_rows, (SELECT count(*) FROM alv a WHERE a.code = s.code AND
  suspend_flag = 0 AND volume <= 0) AS active_zero_volume_rows FROM sym s""", "coverage"))(
    lambda s, d: check.symbol_statistics(_placed(s, d), _life(s, d), symbols(s, d), landed_calendar(s, d))
)
query("selfcheck_columns",
    sql.rounded([sql.TICKS, sql.DAILY_BARS], issue_sql("KLINE_COLUMNS_MISSING", "ERROR", "(SELECT DISTINCT trade_date FROM daily)",
    trade_date="trade_date", expected="'amount, close, code, high, low, open, pre_close, suspend_flag, trade_date, volume'", actual="'amount, volume'")))(
    lambda s, d: shown(check.column_issues([n for n in check.COLUMNS if n not in ("volume", "amount")], landed(s, d)))
)
_ALL = [*LIFE_ISSUES, *SCOPE_ISSUES, *ROW_ISSUES, DUPLICATES, OUTSIDE, *CONTINUITY, *SCAN_ISSUES]
_RUN = [*_ONCE, *CONTINUED, *SCAN, f"issues AS ({union_sql(_ALL)})"]


def _run(s, d) -> DataFrame:
    return check.run(landed_once(s, d), landed_instruments(s, d), symbols(s, d), landed_calendar(s, d), landed_actions(s, d))


query("selfcheck_summary", sql.rounded(_RUN, "SELECT level, issue_code, count(*) AS n, count(DISTINCT code) AS n_codes FROM issues GROUP BY 1, 2"))(
    lambda s, d: issue_frames.summary(_run(s, d)))
query("selfcheck_split_lifecycle",
    sql.rounded(_RUN, "SELECT issue_code, count(*) AS n FROM issues WHERE issue_code IN ('DATA_BEFORE_LISTING', 'DATA_AFTER_DELISTING', "
    "'OPEN_DATE_MISSING', 'OPEN_DATE_INVALID', 'EXPIRE_DATE_INVALID', 'INVALID_LIFECYCLE_RANGE') GROUP BY 1"))(
    lambda s, d: issue_frames.split(_run(s, d))["lifecycle"].groupBy("issue_code").agg(F.count(F.lit(1)).alias("n"))
)
