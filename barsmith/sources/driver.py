"""The engine's inputs over the driver's tables: ticks and actions from events, a long daily panel from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute-bar shape: code, trade_time, trade_date, seq, open, high, low, close, volume, amount."""
    e = read_table(spark, sf_dir, "events")
    price, volume = F.col("value"), F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("code"), F.col("ts").alias("trade_time"), F.to_date("ts").alias("trade_date"), F.col("event_id").alias("seq"),
        *(price.alias(c) for c in ("open", "high", "low", "close")), volume.alias("volume"), (price * volume).alias("amount"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: code, trade_time, trade_date, seq, price columns, volume."""
    t = read_table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return t.select(
        F.col("l_suppkey").cast("string").alias("code"), F.col("l_shipdate").alias("trade_time"), F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), *(price.alias(c) for c in ("open", "high", "low", "close")),
        F.col("l_quantity").alias("volume"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions: code, ex_date, adjustment_factor, seq."""
    e = read_table(spark, sf_dir, "events").filter("event_type = 'signup'")
    factor = 1 + F.get_json_object("props", "$.k").cast("double") / 1000
    return e.select(F.col("user_id").cast("string").alias("code"), F.to_date("ts").alias("ex_date"), factor.alias("adjustment_factor"),
        F.col("event_id").alias("seq"))


def lifecycle(bars: DataFrame) -> DataFrame:
    """Instruments observed in bars: code, open_date, expire_date (NULL if it traded on the last date), board."""
    last = bars.agg(F.max("trade_date").alias("last_date"))
    span = bars.groupBy("code").agg(F.min("trade_date").alias("open_date"), F.max("trade_date").alias("close_date"))
    board = F.when(F.pmod(F.col("code").cast("long"), F.lit(3)) == 0, "star").when(F.pmod(F.col("code").cast("long"), F.lit(3)) == 1,
        "main").otherwise("chinext")
    return span.crossJoin(F.broadcast(last)).select("code", "open_date",
        F.when(F.col("close_date") < F.col("last_date"), F.col("close_date")).alias("expire_date"), board.alias("board"))
