"""Queries of the landing zone: finance, bars, instruments and actions from planted vendor records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import finance, landing
from ..sources import readers
from ..sources.readers import read_table
from . import sql
from .base import daily, query

c = F.col

# ---- finance

TABLES = {"balance": ["assets", "debts"], "income": ["revenue"]}


def finance_records(s, d) -> DataFrame:
    """Vendor records from orders: missing, partial and unparsable ones among them."""
    k = c("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    o = read_table(s, d, "orders").select(F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("code"),
        F.when(k % 3 == 0, "income").otherwise("balance").alias("table"),
        F.concat(F.when(k % 17 == 0, "x").otherwise(day), F.lit("#"), k.cast("string")).alias("key"), k.alias("k"), day.alias("day"), "o_totalprice")
    value = c("o_totalprice").cast("string")
    fields = F.array(
        F.struct(F.lit("report").alias("field"), F.when(c("k") % 11 != 0, F.concat(F.substring("day", 1, 6), F.lit("01"))).alias("value")),
        F.struct(F.lit("announce").alias("field"), F.when(c("k") % 7 != 0, c("day")).alias("value")),
        F.struct(F.lit("assets").alias("field"), F.when(c("k") % 5 == 0, "n/a").when(c("table") == "balance", value).alias("value")),
        F.struct(F.lit("debts").alias("field"), F.when(c("k") % 10 == 0, None).when(c("table") == "balance", value).alias("value")),
        F.struct(F.lit("revenue").alias("field"), F.when((c("k") % 13 != 0) & (c("table") == "income"), value).alias("value")),
    )
    return o.select("code", "table", "key", F.explode(fields).alias("x")).select("code", "table", "key", "x.*")


RAW = """fr AS (SELECT 'c' || o_custkey AS code, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'income' ELSE 'balance' END AS tbl,
    strftime(o_orderdate, '%Y%m%d') AS day, o_totalprice AS v FROM orders)"""


def _parsed_sql(name: str) -> str:
    values = ("CASE WHEN k % 5 <> 0 THEN v END AS assets, CASE WHEN k % 10 <> 0 THEN v END AS debts" if name == "balance"
        else "CASE WHEN k % 13 <> 0 THEN v END AS revenue")
    report = "CASE WHEN k % 11 <> 0 THEN left(day, 6) || '01' WHEN k % 17 <> 0 THEN day WHEN k >= 19000000 THEN left(k::VARCHAR, 8) END"
    return f"{name} AS (SELECT code, k, {report} AS report_date, CASE WHEN k % 7 <> 0 THEN day END AS announce_date, {values} FROM fr WHERE tbl = '{name}')"


PARSED = [RAW, _parsed_sql("balance"), _parsed_sql("income")]


def parsed(s, d, name: str) -> DataFrame:
    return finance.parse(finance_records(s, d), name, "report", "announce", TABLES[name])


for _t, _v in TABLES.items():
    query(f"finance_parse_{_t}",
        sql.rounded(PARSED, f"SELECT code, report_date, announce_date, {', '.join(_v)} FROM {_t} WHERE report_date IS NOT NULL", " ".join(_v)))(
        lambda s, d, t=_t: parsed(s, d, t))
query("finance_raw_partitions",
    sql.rounded(PARSED, "SELECT coalesce(announce_date, 'unknown') AS partition, count(*) AS n FROM balance WHERE report_date IS NOT NULL GROUP BY 1"))(
    lambda s, d: finance.raw_partitions(parsed(s, d, "balance")).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
)


def _codes(s, d) -> DataFrame:
    return read_table(s, d, "customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("code"))


query("finance_parse_issues", sql.rounded([*PARSED, "held AS (SELECT * FROM balance WHERE report_date IS NOT NULL)"], """SELECT dataset, field,
    count(*) AS n FROM (
  SELECT 'finance_raw/balance' AS dataset, 'record' AS field FROM customer WHERE 'c' || c_custkey NOT IN (SELECT code FROM balance)
  UNION ALL SELECT 'finance_raw/balance', 'report_date' FROM balance WHERE report_date IS NULL
  UNION ALL SELECT 'finance_raw/balance', 'announce_date' FROM held WHERE announce_date IS NULL
  UNION ALL SELECT CASE WHEN assets IS NULL AND debts IS NULL THEN 'finance_raw/balance' ELSE 'finance_field/balance' END, 'values' FROM held WHERE
  assets IS NULL OR debts IS NULL) GROUP BY 1, 2"""))(
    lambda s, d: finance.parse_issues(finance_records(s, d), _codes(s, d), "balance", "report", TABLES["balance"],
    parsed(s, d, "balance")).groupBy("dataset", "field").agg(F.count(F.lit(1)).alias("n"))
)


def _pairs(s, d) -> DataFrame:
    o = read_table(s, d, "orders")
    return o.select(F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("code"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 30), "yyyyMMdd").alias("trade_date")).distinct()


PAIRS = "pr AS (SELECT DISTINCT 'c' || o_custkey AS code, strftime(o_orderdate::DATE + 30, '%Y%m%d') AS trade_date FROM orders)"


def _visible(name: str, values: list[str]) -> str:
    order = "{'r': x.report_date, 'a': x.announce_date, " + ", ".join(f"'{v}': x.{v}" for v in values) + "}"
    return (f"v_{name} AS (SELECT p.code, p.trade_date, max({order}) AS m FROM pr p JOIN {name} x ON x.code = p.code AND x.announce_date < "
        f"p.trade_date WHERE x.report_date IS NOT NULL GROUP BY 1, 2)")


def _pit(s, d) -> DataFrame:
    return finance.point_in_time({t: parsed(s, d, t) for t in TABLES}, TABLES, _pairs(s, d))


_SHOWN = "b.m.r AS balance_report_date, b.m.a AS balance_announce_date, i.m.r AS income_report_date, i.m.a AS income_announce_date"
query("finance_pit_wide", sql.rounded([*PARSED, PAIRS, _visible("balance", TABLES["balance"]), _visible("income", TABLES["income"])],
      f"SELECT p.code, p.trade_date, {_SHOWN}, (b.m IS NOT NULL OR i.m IS NOT NULL)::INT AS has_finance FROM pr p LEFT JOIN v_balance b ON b.code = "
      f"p.code AND b.trade_date = p.trade_date LEFT JOIN v_income i ON i.code = p.code AND i.trade_date = p.trade_date"))(
    lambda s, d: _pit(s, d).select("code", "trade_date", "balance_report_date", "balance_announce_date", "income_report_date", "income_announce_date",
    "has_finance")
)
_ONE = ("SELECT p.code, p.trade_date, arg_max(x.revenue, (x.report_date, x.announce_date, coalesce(x.revenue, -1))) AS income_revenue FROM pr p JOIN "
    "income x ON x.code = p.code AND x.announce_date < p.trade_date WHERE x.report_date IS NOT NULL AND x.revenue IS NOT NULL GROUP BY 1, 2")
query("finance_pit_values", sql.rounded([*PARSED, PAIRS], _ONE, "income_revenue"))(
    lambda s, d: finance.point_in_time({"income": parsed(s, d, "income").filter("revenue IS NOT NULL")}, {"income": ["revenue"]},
    _pairs(s, d)).filter("has_finance = 1").select("code", "trade_date", "income_revenue")
)
query("finance_daily_issues",
    sql.rounded([*PARSED, PAIRS], "SELECT code, strptime(trade_date, '%Y%m%d')::DATE AS trade_date FROM pr p WHERE NOT EXISTS (SELECT 1 FROM balance "
    "x WHERE x.code = p.code AND x.report_date IS NOT NULL AND x.announce_date < p.trade_date) AND NOT EXISTS (SELECT 1 FROM income x WHERE x.code = "
    "p.code AND x.report_date IS NOT NULL AND x.announce_date < p.trade_date)"))(
    lambda s, d: finance.daily_issues(_pit(s, d)).select("code", "trade_date")
)

# ---- bars


def vendor_bars(s, d) -> DataFrame:
    """Bars under vendor names, all text, times as dates, milliseconds and rubbish; no amount at all."""
    v = c("volume")
    text = lambda x: x.cast("decimal(20,4)").cast("string")
    ms = (F.unix_timestamp(F.col("trade_date").cast("timestamp")) * 1000).cast("string")
    return daily(s, d).select(
        "code", F.when(v % 5 == 0, ms).when(v % 31 == 0, "never").otherwise(F.date_format("trade_date", "yyyyMMdd")).alias("time"),
        F.when(v % 29 != 0, text(c("open"))).alias("open"),
        F.when(v % 7 == 0, text(c("low") * 0.9)).otherwise(text(c("high"))).alias("high"),
        F.when(v % 11 == 0, text(c("close") * 2)).otherwise(text(c("low"))).alias("low"), text(c("close")).alias("close"),
        F.when(v % 13 == 0, "inf").when(v % 17 == 0, text(-v)).otherwise(text(v)).alias("volume"), F.lit("0").alias("suspendFlag"),
    )


_X = "CAST({0} AS DECIMAL(20,4))::DOUBLE"
VENDOR = [
    sql.TICKS, sql.DAILY_BARS,
    f"""vb AS (SELECT code, strftime(trade_date, '%Y%m%d') AS trade_date, CASE WHEN volume % 29 <> 0 THEN {_X.format('open')} END AS open, CASE WHEN
    volume % 7 = 0 THEN {_X.format('low * 0.9')} ELSE {_X.format('high')} END AS high,
      CASE WHEN volume % 11 = 0 THEN {_X.format('close * 2')} ELSE {_X.format('low')} END AS low, {_X.format('close')} AS close, NULL::DOUBLE AS
      pre_close, CASE WHEN volume % 13 = 0 THEN NULL WHEN volume % 17 = 0 THEN -volume::DOUBLE ELSE volume::DOUBLE END AS volume,
      NULL::DOUBLE AS amount, 0.0::DOUBLE AS suspend_flag FROM daily WHERE NOT (volume % 5 <> 0 AND volume % 31 = 0) AND trade_date BETWEEN DATE
      '2024-01-05' AND DATE '2024-01-25')""",
    "fx0 AS (SELECT *, open IS NOT NULL AS whole, greatest(high, open, close, low) AS h2 FROM vb)",
    "fx AS (SELECT * REPLACE (CASE WHEN whole THEN h2 ELSE high END AS high, CASE WHEN whole THEN least(low, open, close, h2) ELSE low END AS low), "
    "high AS h0, low AS l0 FROM fx0)",
]
_BARS = "open high low close pre_close volume amount suspend_flag"


def _bars(s, d) -> DataFrame:
    return landing.parse_kline(vendor_bars(s, d), "20240105", "20240125")


query("landing_kline_parse", sql.rounded(VENDOR, "SELECT * FROM vb", _BARS))(_bars)
query("landing_kline_corrected", sql.rounded(VENDOR, f"SELECT code, trade_date, {', '.join(_BARS.split())} FROM fx", _BARS))(
    lambda s, d: landing.corrected(_bars(s, d)).drop("old_high", "old_low"))
query("landing_correction_log",
    sql.rounded(VENDOR, "SELECT code, trade_date, 'high' AS field, h0 AS original_value, high AS corrected_value FROM fx WHERE h0 <> high UNION ALL "
    "SELECT code, trade_date, 'low', l0, low FROM fx WHERE l0 <> low", "original_value corrected_value"))(
    lambda s, d: landing.correction_log(landing.corrected(_bars(s, d)))
)
query("landing_kline_issues", sql.rounded(VENDOR, """SELECT issue_code, level, field, count(*) AS n FROM (SELECT 'KLINE_FIELD_INVALID' AS issue_code,
    'WARNING' AS level, 'open,high,low,close' AS field FROM vb WHERE open IS NULL
  UNION ALL SELECT 'INVALID_OHLC_RELATION', 'ERROR', 'high' FROM vb WHERE open IS NOT NULL AND high < greatest(open, close, low)
  UNION ALL SELECT 'INVALID_OHLC_RELATION', 'ERROR', 'low' FROM vb WHERE open IS NOT NULL AND NOT high < greatest(open, close, low) AND low >
  least(open, close, high)
  UNION ALL SELECT 'NEGATIVE_TURNOVER', 'ERROR', 'volume' FROM vb WHERE volume < 0) GROUP BY ALL"""))(
  lambda s, d: landing.kline_issues(_bars(s, d)).groupBy("issue_code", "level", "field").agg(F.count(F.lit(1)).alias("n")))


def vendor_instruments(s, d) -> DataFrame:
    n = c("code").cast("long")
    return daily(s, d).groupBy("code").agg(F.min("trade_date").alias("first")).select(
        F.concat(F.lit(" "), F.when(n % 4 == 0, "688").when(n % 4 == 1, "600").when(n % 4 == 2, "83").otherwise("x1"), F.lpad("code", 3, "0"),
        F.lit(".sh")).alias("code"),
        F.when(n % 5 == 0, F.concat(F.lit("*st "), c("code"))).when(n % 7 != 0, F.concat(F.lit("Co "), c("code"))).alias("instrument_name"),
        F.when(n % 3 == 0, "19700101").otherwise(F.date_format("first", "yyyyMMdd")).alias("open_date"),
        F.when(n % 6 == 0, "20240110").when(n % 6 == 1, "20240124000000").otherwise("99999999").alias("expire_date"),
        F.when(n % 3 == 0, " TRUE").when(n % 3 == 1, "0.0").otherwise("maybe").alias("is_trading"), n.alias("seq"),
    )


VENDOR_LIVES = [
    """vi AS (SELECT CASE n % 4 WHEN 0 THEN '688' WHEN 1 THEN '600' WHEN 2 THEN '83' ELSE 'X1' END || lpad(code, 3, '0') || '.SH' AS code, n, CASE
    WHEN n % 5 = 0 THEN '*st ' || code WHEN n % 7 <> 0 THEN 'Co ' || code ELSE '' END AS instrument_name,
      CASE WHEN n % 3 <> 0 THEN first END AS open_date, CASE WHEN n % 6 = 0 THEN DATE '2024-01-10' WHEN n % 6 = 1 THEN DATE '2024-01-24' END AS
      expire_date, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_trading FROM (SELECT code, code::BIGINT AS n, min(trade_date) AS first
      FROM daily GROUP BY code))""",
]
query("landing_lifecycle_frame",
    sql.rounded([sql.TICKS, sql.DAILY_BARS, *VENDOR_LIVES],
    "SELECT code, instrument_name, open_date, expire_date, is_trading, '' AS instrument_status, CASE n % 4 WHEN 0 THEN 'star' WHEN 1 THEN 'main' WHEN "
    "2 THEN 'bse' ELSE 'unknown' END AS board, n % 5 = 0 AS is_st FROM vi"))(
    # planted codes keep three digits of a number, so that beyond 999 instruments share them: every instrument is returned, by its own number
    lambda s, d: landing.lifecycle_frame(vendor_instruments(s, d), "seq")
)


def _text_lives(s, d) -> DataFrame:
    n = c("code").cast("long")
    return daily(s, d).select("code").distinct().filter(n % 9 != 0).select("code", F.when(n % 3 == 0, "20240110").alias("open_date"),
        F.when(n % 4 == 0, "20240118").alias("expire_date"))


def _dates(s, d) -> DataFrame:
    return daily(s, d).select(F.date_format("trade_date", "yyyyMMdd").alias("trade_date")).distinct().filter(c("trade_date").between("20240105", "20240125"))


query("landing_missing",
    sql.rounded([*VENDOR, "cd AS (SELECT DISTINCT code, code::BIGINT AS n FROM daily)",
    "ds AS (SELECT DISTINCT trade_date AS day FROM daily WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')"],
      "SELECT code, day AS trade_date FROM cd, ds WHERE (n % 9 = 0 OR ((n % 3 <> 0 OR day >= DATE '2024-01-10') AND (n % 4 <> 0 OR day <= DATE "
      "'2024-01-18'))) AND NOT EXISTS (SELECT 1 FROM vb WHERE vb.code = cd.code AND vb.trade_date = strftime(day, '%Y%m%d'))"))(
    lambda s, d: landing.missing_issues(_bars(s, d), daily(s, d).select("code"), _dates(s, d), _text_lives(s, d)).select("code", "trade_date")
)
query("landing_kline_batch", sql.rounded(VENDOR, "SELECT trade_date, count(*) AS n, sum((h0 <> high OR l0 <> low)::INT)::BIGINT AS fixed FROM fx GROUP BY 1"))(
    lambda s, d: (b := landing.kline_batch(vendor_bars(s, d), daily(s, d).select("code"), _dates(s, d), _text_lives(s, d), "20240105", "20240125"))[
    "bars"].groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    .join(b["corrections"].groupBy("trade_date").agg(F.countDistinct("code").alias("fixed")), "trade_date", "left").withColumn("fixed",
    F.coalesce("fixed", F.lit(0)))
)

# ---- instruments and actions


def _previous(s, d) -> DataFrame:
    n = c("code").cast("long")
    return daily(s, d).select("code").distinct().select(F.concat(F.when(n % 8 == 0, "old").otherwise("c"), c("code"),
        F.when(n % 7 != 0, ".SZ").otherwise("")).alias("code"),
                                                        F.when(n % 3 == 0, "20240131").when(n % 3 == 1,
                                                        F.when(n % 2 == 0, "20231201").otherwise("soon")).alias("expire_date"))


def _current(s, d) -> DataFrame:
    return daily(s, d).filter("volume > 150").select(F.concat(F.lit(" c"), "code", F.lit(".sz")).alias("code")).distinct()


query("landing_carried_universe", sql.rounded([sql.TICKS, sql.DAILY_BARS, "cu AS (SELECT DISTINCT 'C' || code || '.SZ' AS code FROM daily WHERE volume > 150)",
      "ol AS (SELECT DISTINCT CASE WHEN n % 8 = 0 THEN 'OLD' ELSE 'C' END || code || '.SZ' AS code FROM (SELECT DISTINCT code, code::BIGINT AS n FROM "
      "daily) WHERE n % 7 <> 0 AND NOT (n % 3 = 1 AND n % 2 = 0))"],
      "SELECT code, false AS carried FROM cu UNION ALL SELECT code, true FROM ol WHERE code NOT IN (SELECT code FROM cu)"))(
      lambda s, d: landing.carried_universe(_current(s, d), _previous(s, d), "20240201"))
query("landing_name_history",
    sql.rounded([sql.TICKS, sql.DAILY_BARS], "SELECT code, CASE WHEN max(volume) > 150 THEN 'new' ELSE 'old' END AS instrument_name FROM daily GROUP BY 1"))(
    lambda s, d: landing.merged_history(daily(s, d).filter("volume > 150").select("code").distinct().withColumn("instrument_name", F.lit("new")),
    daily(s, d).select("code").distinct().withColumn("instrument_name", F.lit("old")))
)


def vendor_actions(s, d) -> DataFrame:
    e = read_table(s, d, "events").filter("event_type = 'signup'")
    k = F.get_json_object("props", "$.k").cast("long")
    some = lambda m: F.when(k % m == 0, "nan").otherwise((k / 1000).cast("string"))
    terms = F.array(some(3), some(5), F.lit("0"), F.lit("0.1"), F.lit("5"), F.lit("0"), (1 + k / 1000).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("code"), F.date_format("ts", "yyyyMMdd").alias("time"),
        F.when(k % 7 == 0, F.slice(terms, 1, 4)).otherwise(terms).alias("values"))


ACTIONS = ["va AS (SELECT user_id::VARCHAR AS code, strftime(ts, '%Y%m%d') AS ex_date, json_extract_string(props, '$.k')::BIGINT AS k FROM events "
    "WHERE event_type = 'signup')", "vr AS (SELECT * FROM va WHERE ex_date BETWEEN '20240105' AND '20240120')"]
_TERMS = " ".join(landing.ACTION_TERMS)
query("landing_actions_parse", sql.rounded(ACTIONS, """SELECT code, ex_date, CASE WHEN k % 3 <> 0 THEN k / 1000.0::DOUBLE END AS
    cash_dividend_per_share, CASE WHEN k % 5 <> 0 THEN k / 1000.0::DOUBLE END AS bonus_share_per_share, 0.0::DOUBLE AS capitalization_per_share,
    0.1::DOUBLE AS rights_issue_per_share,
  5.0::DOUBLE AS rights_issue_price, 0.0::DOUBLE AS share_reform_flag, 1 + k / 1000.0::DOUBLE AS adjustment_factor FROM vr WHERE k % 7 <> 0""",
  _TERMS))(lambda s, d: landing.parse_actions(vendor_actions(s, d), "20240105", "20240120"))
query("landing_action_issues",
    sql.rounded(ACTIONS, "SELECT code, strptime(ex_date, '%Y%m%d')::DATE AS trade_date, '4' AS actual FROM vr WHERE k % 7 = 0"))(
    lambda s, d: landing.action_issues(vendor_actions(s, d), "20240105", "20240120").select("code", "trade_date", "actual"))
query("landing_action_partitions", sql.rounded([sql.TICKS, sql.DAILY_BARS, *ACTIONS, "ok AS (SELECT * FROM vr WHERE k % 7 <> 0)"],
    "SELECT ex_date, count(k) AS rows FROM (SELECT ex_date, k FROM ok UNION ALL SELECT DISTINCT strftime(trade_date, '%Y%m%d'), "
    "NULL FROM daily WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') GROUP BY 1"))(
    lambda s, d: landing.action_partitions(landing.parse_actions(vendor_actions(s, d), "20240105", "20240120"), _dates(s, d))
)

# ---- minute rows of the vendor's files


def _minute_text(s, d) -> DataFrame:
    e = read_table(s, d, "events")
    k = c("event_id")
    time = F.when(k % 3 == 0, F.date_format("ts", "yyyyMMddHHmm")).when(k % 17 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    price = c("value").cast("string")
    return e.select(F.concat(F.lit(" u"), c("user_id").cast("string")).alias("code"), time.alias("trade_time"),
        *[F.when(k % 5 == 0, "-").otherwise(price).alias(n) for n in ("open", "high", "low", "close")],
        (k % 100 + 0.6).cast("string").alias("volume"), F.lit("1").alias("amount"))


query("landing_minute_rows", sql.rounded([], """SELECT 'U' || user_id AS code, (CASE WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) ELSE
    date_trunc('second', ts) END)::TIMESTAMP AS trade_time, CASE WHEN event_id % 5 <> 0 THEN value END AS close, (event_id % 100 + 1)::BIGINT AS
    volume, ts::DATE AS trade_date
  FROM events WHERE event_id % 3 = 0 OR event_id % 17 <> 0""", "close"))(lambda s, d: readers.normalised_bars(_minute_text(s, d)).select("code",
  "trade_time", "close", "volume", "trade_date"))
