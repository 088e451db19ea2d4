"""Queries of the store: landing trees are written to the shared scratch folder, synced, and what the store then holds is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store as daily_store
from ..operators.landing import ACTION_TERMS
from ..scratch import shared_dir
from ..sources import files
from ..sources import landing as source
from . import sql
from .base import SPLIT, daily, query

c = F.col


def _text(x):
    return x.cast("decimal(24,4)").cast("string")


def landed_bars(s, d) -> DataFrame:
    """Landing rows, a partition per date, some to be filtered out."""
    v = c("volume")
    day = F.date_format("trade_date", "yyyyMMdd")
    return daily(s, d).select(
        day.alias("date"), F.concat(F.lit("c"), "code").alias("code"),
        F.when(v % 31 == 0, "2024011").when(v % 37 == 0, "20241332").otherwise(day).alias("trade_date"), _text(c("open")).alias("open"),
        _text(c("high")).alias("high"),
        _text(c("low")).alias("low"), _text(c("close")).alias("close"), F.lit(None).cast("string").alias("pre_close"),
        F.when(v % 3 == 0, "0").otherwise(_text(v + 0.6)).alias("volume"), F.lit("1.5").alias("amount"),
        F.when(v % 11 == 0, "1").otherwise("0").alias("suspend_flag"),
    )


def landed_lives(s, d) -> DataFrame:
    n = c("code").cast("long")
    first = daily(s, d).groupBy("code").agg(F.min("trade_date").alias("first")).filter(n % 10 != 0)
    return first.select(
        F.lit("latest").alias("snapshot"), F.concat(F.lit("C"), "code").alias("code"), F.lit("name").alias("instrument_name"),
        F.date_format(F.date_add("first", F.when(n % 7 == 0, 3).otherwise(0)), "yyyyMMdd").alias("open_date"),
        F.when(n % 5 == 0, F.lit(SPLIT.strftime("%Y%m%d"))).otherwise("99999999").alias("expire_date"), F.lit("1").alias("is_trading"),
        F.lit("ok").alias("instrument_status"),
    )


def landed_actions(s, d) -> DataFrame:
    v = c("volume")
    day = F.date_format("trade_date", "yyyyMMdd")
    return daily(s, d).filter(v % 9 == 0).select(day.alias("ex_date"), F.concat(F.lit("c"), "code").alias("code"),
        *[F.lit("1.25" if t == "adjustment_factor" else "0").alias(t) for t in ACTION_TERMS])


def landed_tree(s, d) -> str:
    """A landing tree below a new scratch folder."""
    root = f"{shared_dir(s)}/barsmith/landed-{uuid.uuid4().hex}"
    source.write(landed_bars(s, d), root, "kline_1d", "date", ["code"])
    source.write(landed_lives(s, d), root, "instrument_info", "snapshot", ["code"])
    source.write(landed_actions(s, d), root, "corporate_actions", "ex_date", ["code"])
    days = daily(s, d).select(F.lit("latest").alias("snapshot"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"),
        F.lit("SH").alias("calendar_symbol")).distinct()
    source.write(days, root, "trading_calendar", "snapshot", ["trade_date"])
    return root


def new_store(s, d) -> daily_store.DailyStore:
    landed = landed_tree(s, d)
    out = daily_store.DailyStore(s, landed.replace("landed-", "store-"), landed)
    out.sync("rebuild")
    return out


_SYNCED: dict[tuple[str, str], daily_store.DailyStore] = {}


def synced(s, d) -> daily_store.DailyStore:
    """A store of this application that queries only read."""
    key = (s.sparkContext.applicationId, d)
    if key not in _SYNCED:
        _SYNCED[key] = new_store(s, d)
    return _SYNCED[key]


LIVES = [
    sql.TICKS, sql.DAILY_BARS,
    f"lf AS (SELECT code, (first + CASE WHEN n % 7 = 0 THEN 3 ELSE 0 END)::DATE AS open_date, CASE WHEN n % 5 = 0 THEN DATE '{SPLIT}' END AS "
    f"expire_date FROM (SELECT code, code::BIGINT AS n, min(trade_date) AS first FROM daily GROUP BY code) WHERE n % 10 <> 0)",
]


def kept_sql(source_cte: str = "daily") -> list[str]:
    return [
        f"""jd AS (SELECT b.*, CASE WHEN b.volume % 31 = 0 THEN 'trade_date_bad_length' WHEN b.volume % 37 = 0 THEN 'trade_date_unparsable' WHEN
        l.code IS NULL THEN 'unknown_code' WHEN b.trade_date < l.open_date AND b.volume % 3 = 0 THEN 'before_listing_padding'
          WHEN b.trade_date < l.open_date THEN 'before_listing_with_data' WHEN b.trade_date > l.expire_date THEN 'after_delisting' ELSE 'kept' END AS
          reason FROM {source_cte} b LEFT JOIN lf l ON l.code = b.code)""",
        """kp AS (SELECT 'C' || code AS code, trade_date, CAST(open AS DECIMAL(24,4))::DOUBLE AS open, CAST(close AS DECIMAL(24,4))::DOUBLE AS close,
        CASE WHEN volume % 3 = 0 THEN 0 ELSE volume + 1 END::BIGINT AS volume, CASE WHEN volume % 11 = 0 THEN 1 ELSE 0 END::TINYINT AS suspend_flag
        FROM jd WHERE reason = 'kept')""",
    ]


_BARS = ["code", "trade_date", "open", "close", "volume", "suspend_flag"]
query("store_rebuild", sql.rounded([*LIVES, *kept_sql()], "SELECT * FROM kp", "open close"))(lambda s, d: synced(s, d).bars(suspended=True).select(*_BARS))
query("store_bars_scan",
    sql.rounded([*LIVES, *kept_sql()],
    "SELECT * FROM kp WHERE trade_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND suspend_flag = 0 AND code IN ('C1', 'C2', 'C3', 'C11')",
    "open close"))(
    lambda s, d: synced(s, d).bars("2024-01-10", "2024-01-20", [" c1", "C2", "C3", "C11"]).select(*_BARS)
)
query("store_symbols",
    sql.rounded([*LIVES, *kept_sql()], "SELECT code, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS bar_count, "
    "sum(suspend_flag)::BIGINT AS suspended_days FROM kp GROUP BY 1"))(lambda s, d: synced(s, d).table("symbols"))
query("store_inventory",
    sql.rounded([*LIVES, *kept_sql()],
    "SELECT year(trade_date)::INT AS year, month(trade_date)::INT AS month, count(*) AS rows, count(DISTINCT code) AS symbols, "
    "count(DISTINCT trade_date) AS trading_days, min(trade_date) AS min_date, max(trade_date) AS max_date FROM kp GROUP BY 1, 2"))(
    lambda s, d: synced(s, d).table("monthly_inventory")
)
query("store_actions",
    sql.rounded([sql.TICKS, sql.DAILY_BARS],
    "SELECT 'C' || code AS code, trade_date AS ex_date, 1.25::DOUBLE AS adjustment_factor FROM daily WHERE volume % 9 = 0", "adjustment_factor"))(
    lambda s, d: synced(s, d).table("corporate_actions").select("code", "ex_date", "adjustment_factor")
)
query("store_calendar", sql.rounded([sql.TICKS, sql.DAILY_BARS], "SELECT DISTINCT trade_date, 'SH' AS calendar_symbol FROM daily"))(
    lambda s, d: synced(s, d).table("trading_calendar"))


def _filtered(s, d) -> DataFrame:
    landed = landed_tree(s, d)
    report = daily_store.DailyStore(s, landed.replace("landed-", "store-"), landed).sync()
    return s.createDataFrame(list(report.filtered.items()), "reason string, n long")


_REASONS = ("['trade_date_null', 'trade_date_bad_length', 'trade_date_unparsable', 'unknown_code', 'before_listing_padding', "
    "'before_listing_with_data', 'after_delisting', 'kept']")
query("store_filter_summary",
    sql.rounded([*LIVES, *kept_sql()],
    f"SELECT r.reason, count(j.reason) AS n FROM (SELECT unnest({_REASONS}) AS reason) r LEFT JOIN jd j ON j.reason = r.reason GROUP BY 1"))(_filtered)


def _incremental(s, d) -> DataFrame:
    """One day changed, one gone; an automatic run brings the store up to date."""
    store = new_store(s, d)
    changed = landed_bars(s, d).filter("date = '20240110'").withColumn("close", F.lit("7.5"))
    source.write(changed, store.landed, "kline_1d", "date", ["code"], overwrite=True)
    files.delete(s, f"{store.landed}/kline_1d/date=20240111")
    store.sync()
    return store.bars(suspended=True).select(*_BARS)


query("store_incremental",
    sql.rounded([*LIVES, "changed AS (SELECT * REPLACE (CASE WHEN trade_date = DATE '2024-01-10' THEN 7.5 ELSE close END AS close) FROM daily WHERE "
    "trade_date <> DATE '2024-01-11')", *kept_sql("changed")], "SELECT * FROM kp", "open close"))(_incremental)


def _checked(s, d) -> DataFrame:
    """Partitions of a tree in which one file is changed, one marker broken, one gone, one folder misnamed."""
    root = landed_tree(s, d)
    parts = {p.value: p for p in source.partitions(s, root, "kline_1d", "date")}
    data = files.listed(s, f"{parts['20240103'].path}/*.csv")[0]
    files.write_text(s, data.path, files.read_text(s, data.path) + "extra,row\n")
    files.write_text(s, f"{parts['20240104'].path}/{source.MARKER}", "{broken")
    files.write_text(s, f"{parts['20240105'].path}/{source.MARKER}", "[1]")
    files.delete(s, f"{parts['20240106'].path}/{source.MARKER}")
    files.write_text(s, f"{root}/kline_1d/date=2024-13/{source.MARKER}", "{}")
    return source.partition_issues(s, root, "kline_1d", "date").select("issue_code", "level", F.col("source_file").alias("partition"))


query("store_partition_issues", sql.rounded([], """SELECT * FROM (VALUES ('PARTITION_HASH_MISMATCH', 'ERROR', 'date=20240103'),
    ('PARTITION_ROW_COUNT_MISMATCH', 'ERROR', 'date=20240103'), ('PARTITION_MARKER_INVALID', 'ERROR', 'date=20240104'),
  ('PARTITION_MARKER_SCHEMA_INVALID', 'ERROR', 'date=20240105'), ('PARTITION_FILE_MISSING', 'ERROR', 'date=20240106'), ('INVALID_PARTITION_DATE',
  'ERROR', 'date=2024-13')) t(issue_code, level, partition)"""))(_checked)
query("store_partition_digests",
    sql.rounded([sql.TICKS, sql.DAILY_BARS],
    "SELECT 'date=' || strftime(trade_date, '%Y%m%d') AS partition, count(*) AS rows, NULL::VARCHAR AS problem FROM daily GROUP BY 1"))(
    lambda s, d: source.verified(s, synced(s, d).landed, "kline_1d", "date").select("partition", "rows", "problem")
)
