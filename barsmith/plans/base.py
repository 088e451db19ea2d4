"""Registration of queries, and the frames over the driver's tables that many of them share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsl
from ..operators import backtest, market, research
from ..sources.driver import fills, ticks
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SPLIT = dt.date(2024, 1, 20)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as the SQL gives them."""
    return df.select(*[(F.round(F.col(f"`{c}`") + 1.23e-8, 6) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def daily(s, d) -> DataFrame:
    return market.daily(ticks(s, d))


def panel(s, d) -> DataFrame:
    return market.daily(fills(s, d))


def audited(s, d) -> DataFrame:
    """Daily bars with defects planted by volume, for the audit rules to find."""
    hit = lambda k: F.col("volume") % k == 0
    x = daily(s, d).withColumn("pre_close", F.when(hit(7), 1.03).otherwise(1.0) * F.lag("close").over(Window.partitionBy("code").orderBy("trade_date")))
    return x.select(
        "code", "trade_date", "open", F.when(hit(13), F.col("low") * 0.9).otherwise(F.col("high")).alias("high"), "low", "close",
        F.when(hit(17), 0).otherwise(F.col("volume")).alias("volume"),
        (F.col("close") * F.when(hit(19), 0).otherwise(F.col("volume"))).alias("amount"),
        F.when(hit(11), 1).when(hit(23), 5).otherwise(0).alias("suspend_flag"), "pre_close",
    )


def predictions(s, d) -> DataFrame:
    out = research.forward_targets(dsl.evaluate(daily(s, d), {"score": sql.SCORE}), "inday")
    return out.select("target_date", "target_end_date", "code", "score", "target_return")


def portfolio(s, d) -> DataFrame:
    return backtest.daily_returns(backtest.top_n(predictions(s, d), 10), 0.0003, 0.001)


def labelled(s, d) -> DataFrame:
    return predictions(s, d).filter("score IS NOT NULL").withColumn("label", research.direction_label(F.col("target_return")).cast("int"))


def ic_of(s, d) -> DataFrame:
    return research.daily_ic(predictions(s, d), "score")
