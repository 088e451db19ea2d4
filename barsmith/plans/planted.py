"""Inputs with planted defects for the audits, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.driver import lifecycle
from ..sources.readers import read_table
from . import sql
from .base import SPLIT, daily

c = F.col


def number() -> Column:
    return c("code").cast("long")


def store_code() -> Column:
    n = number()
    return F.when(n % 29 == 0, F.lpad("code", 6, "0")).otherwise(F.concat(F.lpad("code", 6, "0"), F.when(n % 2 == 0, ".SZ").otherwise(".SH")))


CODE_SQL = "CASE WHEN code::BIGINT % 29 = 0 THEN lpad(code, 6, '0') ELSE lpad(code, 6, '0') || CASE WHEN code::BIGINT % 2 = 0 THEN '.SZ' ELSE '.SH' END END"


def store(s, d) -> DataFrame:
    """Daily bars of the store with defects of every kind, chosen by volume."""
    hit = lambda k: c("volume") % k == 0
    x = daily(s, d).withColumn("before", F.lag("close").over(Window.partitionBy("code").orderBy(c("trade_date").asc_nulls_last())))
    none = F.lit(None).cast("double")
    return x.select(
        store_code().alias("code"),
        "trade_date",
        F.when(hit(31), -c("open")).otherwise(c("open")).alias("open"),
        F.when(hit(13), c("low") * 0.9).otherwise(c("high")).alias("high"),
        "low",
        F.when(hit(37), none).otherwise(c("close")).alias("close"),
        F.when(hit(17), 0.0).when(hit(41), -c("volume").cast("double")).when(hit(43), none).otherwise(c("volume").cast("double")).alias("volume"),
        F.when(hit(19), 0.0).otherwise(c("close") * c("volume") * F.when(hit(47), 1.5).otherwise(1.0)).alias("amount"),
        F.when(hit(11), 1).when(hit(23), 5).when(hit(53), None).otherwise(0).alias("suspend_flag"),
        (F.when(hit(7), 1.03).otherwise(1.0) * c("before")).alias("pre_close"),
    )


STORE = [
    sql.TICKS,
    sql.DAILY_BARS,
    f"""store AS (SELECT {CODE_SQL} AS code, trade_date,
      CASE WHEN volume % 31 = 0 THEN -open ELSE open END AS open,
      CASE WHEN volume % 13 = 0 THEN low * 0.9 ELSE high END AS high,
      low,
      CASE WHEN volume % 37 = 0 THEN NULL ELSE close END AS close,
      CASE WHEN volume % 17 = 0 THEN 0.0 WHEN volume % 41 = 0 THEN -volume::DOUBLE WHEN volume % 43 = 0 THEN NULL ELSE volume::DOUBLE END::DOUBLE AS volume,
      CASE WHEN volume % 19 = 0 THEN 0.0 ELSE close * volume * CASE WHEN volume % 47 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END END::DOUBLE AS amount,
      CASE WHEN volume % 11 = 0 THEN 1 WHEN volume % 23 = 0 THEN 5 WHEN volume % 53 = 0 THEN NULL ELSE 0 END AS suspend_flag,
      CASE WHEN volume % 7 = 0 THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END * lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS pre_close
      FROM daily)""",
]


def instruments(s, d) -> DataFrame:
    """Lives of most codes: late, missing, reversed or ended, with boards and warning flags."""
    n = number()
    opened = F.date_add("open_date", F.when(n % 7 == 0, 3).otherwise(0))
    board = F.element_at(F.array(*map(F.lit, ("star", "main", "chinext", "bse", "unknown"))), (n % 5 + 1).cast("int"))
    return lifecycle(daily(s, d)).filter(n % 10 != 0).select(
        store_code().alias("code"),
        F.when(n % 13 != 0, opened).alias("open_date"),
        F.when(n % 17 == 0, F.date_sub(opened, 1)).when(n % 6 == 0, F.lit(SPLIT)).otherwise(c("expire_date")).alias("expire_date"),
        board.alias("board"),
        (n % 4 == 0).alias("is_st"),
    )


INSTRUMENTS = [
    sql.LIFE,
    f"""instruments AS (SELECT {CODE_SQL} AS code, CASE WHEN n % 13 <> 0 THEN opened END AS open_date,
      (CASE WHEN n % 17 = 0 THEN opened - 1 WHEN n % 6 = 0 THEN DATE '{SPLIT}' ELSE expire_date END)::DATE AS expire_date,
      ['star', 'main', 'chinext', 'bse', 'unknown'][n % 5 + 1] AS board, n % 4 = 0 AS is_st
      FROM (SELECT *, code::BIGINT AS n, (open_date + CASE WHEN code::BIGINT % 7 = 0 THEN 3 ELSE 0 END)::DATE AS opened FROM life) WHERE n % 10 <> 0)""",
]


def calendar(s, d) -> DataFrame:
    """The observed dates but for the seventh, and one date without bars."""
    extra = s.sql("SELECT DATE '2024-02-05' AS trade_date")
    return daily(s, d).select("trade_date").distinct().filter(F.dayofmonth("trade_date") != 7).unionByName(extra)


CALENDAR = "calendar AS (SELECT DISTINCT trade_date FROM daily WHERE day(trade_date) <> 7 UNION ALL SELECT DATE '2024-02-05')"


def actions(s, d) -> DataFrame:
    """One corporate action per code and day: the last signup that gives a number."""
    e = read_table(s, d, "events").filter("event_type = 'signup'").select(F.col("user_id").cast("string").alias("code"),
        F.to_date("ts").alias("ex_date"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    one = e.groupBy("code", "ex_date").agg(F.max_by("k", F.when(c("k").isNotNull(), c("event_id"))).alias("k"))
    return one.select(
        store_code().alias("code"), "ex_date", (1 + c("k") / 1000).alias("adjustment_factor"), (c("k") / 1000).alias("cash_dividend_per_share"),
        (c("k") % 4 / 10).alias("bonus_share_per_share"),
        F.lit(None).cast("double").alias("capitalization_per_share"), (c("k") % 3 / 20).alias("rights_issue_per_share"), F.lit(5.0).alias("rights_issue_price"),
    )


ACTIONS = f"""actions AS (SELECT {CODE_SQL} AS code, ex_date, 1 + k / 1000::DOUBLE AS adjustment_factor, k / 1000::DOUBLE AS cash, (k % 4) /
    10::DOUBLE AS bonus, (k % 3) / 20::DOUBLE AS rights, 5.0::DOUBLE AS price
  FROM (SELECT user_id::VARCHAR AS code, ts::DATE AS ex_date, arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS k FROM events WHERE
  event_type = 'signup' GROUP BY 1, 2))"""


SHOWN = ["issue_code", "level", "code", "trade_date", "start_date", "end_date", "field", "expected", "actual"]


def shown(issues: DataFrame) -> DataFrame:
    return issues.select(*SHOWN)


def said(x: str) -> str:
    return f"coalesce(CAST({x} AS DECIMAL(24,4))::VARCHAR, 'null')"


def issue_sql(name: str, level: str, source: str, **columns: str) -> str:
    """SELECT of the shown columns; columns not given are NULL. name may be a SQL expression in parentheses."""
    given = {"issue_code": name if name.startswith("(") else f"'{name}'", "level": level if level.startswith("(") else f"'{level}'"} | columns
    types = {"trade_date": "DATE", "start_date": "DATE", "end_date": "DATE"}
    return "SELECT " + ", ".join(f"({given.get(k, 'NULL')})::{types.get(k, 'VARCHAR')} AS {k}" for k in SHOWN) + f" FROM {source}"
