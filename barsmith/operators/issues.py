"""Audit issues: one shape of rows for both audits, the catalogue of their codes, counts and splits of them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every issue code and its usual level.
STORE_CODES = {
    "CROSS_5M_CLOSE_MISMATCH": "WARNING", "CROSS_5M_MISSING_DAILY": "WARNING", "CROSS_5M_MISSING_INTRADAY": "WARNING", "CROSS_5M_UNAVAILABLE": "INFO",
    "CROSS_5M_VOLUME_MISMATCH": "WARNING",
    "DAILY_ACTIVE_ZERO_AMOUNT": "ERROR", "DAILY_ACTIVE_ZERO_VOLUME": "ERROR", "DAILY_ADJUST_FACTOR_MISMATCH": "ERROR",
    "DAILY_ADJUST_THEORY_MISMATCH": "WARNING", "DAILY_CALENDAR_DATE_EMPTY": "ERROR",
    "DAILY_CALENDAR_UNAVAILABLE": "ERROR", "DAILY_CODE_FORMAT_INVALID": "ERROR", "DAILY_CORPORATE_ACTION_WITHOUT_BAR": "WARNING",
    "DAILY_COVERAGE_BELOW_THRESHOLD": "ERROR", "DAILY_DATA_AFTER_DELISTING": "ERROR",
    "DAILY_DATA_BEFORE_LISTING": "ERROR", "DAILY_DATE_NOT_IN_CALENDAR": "ERROR", "DAILY_DELISTED_SYMBOL_MISSING": "WARNING",
    "DAILY_DUPLICATE_KEY": "ERROR", "DAILY_INVALID_LIFECYCLE_RANGE": "ERROR",
    "DAILY_INVALID_SUSPEND_FLAG": "ERROR", "DAILY_LIFECYCLE_UNAVAILABLE": "ERROR", "DAILY_LIFECYCLE_UNKNOWN": "WARNING",
    "DAILY_MISSING_SPAN": "ERROR", "DAILY_NEGATIVE_QUANTITY": "ERROR", "DAILY_NONPOSITIVE_PRICE": "ERROR",
    "DAILY_NO_DELISTED_SYMBOLS": "WARNING", "DAILY_NULL_FIELD": "ERROR", "DAILY_OHLC_VIOLATION": "ERROR", "DAILY_OPEN_DATE_MISSING": "WARNING",
    "DAILY_PRE_CLOSE_MISMATCH": "ERROR", "DAILY_PRICE_LIMIT_VIOLATION": "WARNING",
    "DAILY_SUSPENDED_WITH_TURNOVER": "ERROR", "DAILY_VOLUME_UNIT_AMBIGUOUS": "WARNING", "DAILY_VWAP_OUT_OF_RANGE": "WARNING",
}
SOURCE_CODES = {
    "ABNORMAL_PRICE_JUMP": "WARNING", "ABNORMAL_VOLUME_SCALE": "WARNING", "ACTIVE_ZERO_AMOUNT": "ERROR", "ACTIVE_ZERO_VOLUME": "ERROR",
    "AUXILIARY_HASH_MISMATCH": "ERROR", "AUXILIARY_MARKER_INVALID": "ERROR",
    "AUXILIARY_MARKER_MISSING": "ERROR", "AUXILIARY_MARKER_SCHEMA_INVALID": "ERROR", "CALENDAR_INFERRED_FROM_PARTITIONS": "ERROR",
    "DATA_AFTER_DELISTING": "ERROR", "DATA_BEFORE_LISTING": "ERROR",
    "DATA_ON_NON_TRADING_DATE": "ERROR", "DATE_SYMBOLS_MISSING": "ERROR", "DUPLICATE_PARTITION_DATE": "ERROR", "EXPECTED_SYMBOLS_EMPTY": "ERROR",
    "EXPIRE_DATE_INVALID": "ERROR", "INSTRUMENT_INFO_COLUMNS_MISSING": "ERROR",
    "INSTRUMENT_INFO_DUPLICATE": "ERROR", "INSTRUMENT_INFO_MISSING": "ERROR", "INSTRUMENT_INFO_OUTSIDE_SCOPE": "WARNING",
    "INSTRUMENT_INFO_ROW_COUNT_MISMATCH": "ERROR", "INSTRUMENT_INFO_UNREADABLE": "ERROR",
    "INVALID_LIFECYCLE_RANGE": "ERROR", "INVALID_OHLC_RELATION": "ERROR", "INVALID_PARTITION_DATE": "ERROR", "INVALID_SUSPEND_FLAG": "ERROR",
    "KLINE_CODE_MISSING": "ERROR", "KLINE_COLUMNS_MISSING": "ERROR",
    "KLINE_DATASET_MISSING": "ERROR", "KLINE_DATE_PARTITION_MISMATCH": "ERROR", "KLINE_DUPLICATE_KEY": "ERROR", "KLINE_FIELD_INVALID": "ERROR",
    "KLINE_MISSING_SPAN": "ERROR", "KLINE_PARTITION_UNREADABLE": "ERROR",
    "KLINE_SYMBOL_OUTSIDE_SCOPE": "ERROR", "LOW_DATE_COVERAGE": "ERROR", "MISSING_DATE_PARTITION": "ERROR", "NEGATIVE_TURNOVER": "ERROR",
    "OPEN_DATE_INVALID": "ERROR", "OPEN_DATE_MISSING": "INFO",
    "PARTITION_FILE_MISSING": "ERROR", "PARTITION_HASH_MISMATCH": "ERROR", "PARTITION_MARKER_INVALID": "ERROR",
    "PARTITION_MARKER_SCHEMA_INVALID": "ERROR", "PARTITION_ROW_COUNT_MISMATCH": "ERROR",
    "PARTITION_SCOPE_MISMATCH": "ERROR", "PRE_CLOSE_DISCONTINUITY": "INFO", "PRE_CLOSE_DISCONTINUITY_EXPLAINED": "INFO",
    "STAGING_BATCHES_MISSING": "ERROR", "STAGING_BATCH_HASH_MISMATCH": "ERROR",
    "STAGING_BATCH_HASH_MISSING": "ERROR", "STAGING_BATCH_METADATA_INVALID": "ERROR", "STAGING_BATCH_METADATA_MISSING": "ERROR",
    "STAGING_BATCH_ROW_COUNT_MISMATCH": "ERROR", "STAGING_DAILY_BATCH_GAPS": "ERROR",
    "STAGING_JOB_AMBIGUOUS": "ERROR", "SUSPENDED_PRICE_NOT_FLAT": "WARNING", "SUSPENDED_WITH_TURNOVER": "ERROR",
    "SYMBOLS_MISSING_INSTRUMENT_INFO": "ERROR", "SYMBOL_ALL_DATA_MISSING": "ERROR",
}
LEVELS = STORE_CODES | SOURCE_CODES
COLUMNS = ["issue_code", "level", "dataset", "code", "trade_date", "start_date", "end_date", "field", "expected", "actual", "evidence", "source_file",
    "source_row"]
_TYPES = {"trade_date": "date", "start_date": "date", "end_date": "date", "source_row": "long"}
SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in COLUMNS)
#: Topics of the split reports.
TOPICS = {
    "lifecycle": ["DATA_BEFORE_LISTING", "DATA_AFTER_DELISTING", "OPEN_DATE_MISSING", "OPEN_DATE_INVALID", "EXPIRE_DATE_INVALID", "INVALID_LIFECYCLE_RANGE"],
    "volume": ["ACTIVE_ZERO_VOLUME", "ACTIVE_ZERO_AMOUNT", "NEGATIVE_TURNOVER", "SUSPENDED_WITH_TURNOVER"],
    "partition": [c for c in SOURCE_CODES if c.startswith(("PARTITION_", "STAGING_", "AUXILIARY_")) or "PARTITION" in c],
    "statistical": ["ABNORMAL_PRICE_JUMP", "ABNORMAL_VOLUME_SCALE", "PRE_CLOSE_DISCONTINUITY", "PRE_CLOSE_DISCONTINUITY_EXPLAINED"],
}


def four_decimals(value: Column) -> Column:
    """A double as text with four decimals.

    As in SQL, ten thousand times the double is rounded half away from zero and taken exactly, in two halves; a cast would round the shortest text of
    the double, whose ties fall elsewhere and whose digits end sooner. What has more than 24 digits is left to the cast.
    """
    scaled, half = F.round(value.cast("double") * 10_000.0), 4294967296
    high = (scaled / float(half)).cast("long")
    low = (scaled - high.cast("double") * float(half)).cast("long")
    exact = (high.cast("decimal(15,0)") * F.lit(Decimal(half)) + low.cast("decimal(10,0)")) * F.lit(Decimal("0.0001"))
    return F.when(F.abs(scaled) < 1e24, exact.cast("decimal(24,4)")).otherwise(value.cast("decimal(24,4)")).cast("string")


def said(value: Column) -> Column:
    """A number as text with four decimals, NULL as "null"."""
    return F.coalesce(four_decimals(value), F.lit("null"))


def said_all(*parts: tuple[str, Column] | Column) -> Column:
    """name=number pairs, space apart."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{p[0]}="), said(p[1])) if isinstance(p, tuple) else p for p in parts])


def issue(name: str | Column, dataset: str = "bars_1d", level: str | Column | None = None, **values: Column | str | None) -> list[Column]:
    """The columns of an issue of code `name`; columns not given are NULL, the level is the catalogue's."""
    if unknown := set(values) - set(COLUMNS):
        raise ValueError(f"no issue columns: {sorted(unknown)}")
    if level is None:
        if not isinstance(name, str):
            raise ValueError("give the level of a computed code")
        level = LEVELS[name]
    given = {"issue_code": name, "level": level, "dataset": dataset, **values}
    out = []
    for c in COLUMNS:
        v = given.get(c)
        v = v if isinstance(v, Column) else F.lit(v)
        out.append(v.cast(_TYPES.get(c, "string")).alias(c))
    return out


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary(issues: DataFrame) -> DataFrame:
    """level, issue_code, number of issues and of codes."""
    return issues.groupBy("level", "issue_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("n_codes"))


def samples(issues: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` issues of each code, by code and date, as reports show them; total is the number of all."""
    from pyspark.sql import Window

    by = Window.partitionBy("issue_code")
    place = F.row_number().over(by.orderBy("code", "trade_date", "start_date", "field", "actual"))
    totals = issues.groupBy("issue_code").agg(F.count(F.lit(1)).alias("total"))
    return issues.withColumn("place", place).filter(F.col("place") <= limit).withColumn("place", F.col("place").cast("long")).join(totals, "issue_code")


def status(issues: DataFrame) -> DataFrame:
    """status (failed if there is any error), errors, warnings, info."""
    n = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, 1).otherwise(0)), F.lit(0)).cast("long")
    return issues.agg(F.when(n("ERROR") > 0, "failed").otherwise("passed").alias("status"), n("ERROR").alias("errors"),
        n("WARNING").alias("warnings"), n("INFO").alias("info"))


def split(issues: DataFrame) -> dict[str, DataFrame]:
    """Report name to its issues: one per level and one per topic."""
    out = {level.lower(): issues.filter(F.col("level") == level) for level in ("ERROR", "WARNING", "INFO")}
    return out | {topic: issues.filter(F.col("issue_code").isin(codes)) for topic, codes in TOPICS.items()}


def downgrade(issues: DataFrame, codes: list[str], carried: DataFrame, level: str = "INFO") -> DataFrame:
    """Issues of `codes` about carried-over or placeholder rows (carried: code) at a lower level."""
    x = issues.join(carried.select("code").distinct().withColumn("__carried", F.lit(True)), "code", "left")
    lower = F.coalesce(F.col("__carried"), F.lit(False)) & F.col("issue_code").isin(codes)
    return x.withColumn("level", F.when(lower, level).otherwise(F.col("level"))).select(*issues.columns)
