"""Sinks: month-partitioned bar stores and landing CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bars(bars: DataFrame, path: str, time: str = "trade_time") -> None:
    """Replace the months present in bars (others stay): ZSTD Parquet by year and month, sorted for code scans."""
    out = bars.withColumn("year", F.year(time)).withColumn("month", F.month(time))
    out = out.repartitionByRange("year", "month", "code").sortWithinPartitions("year", "month", "code", time)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(path)


def identity_digest(df: DataFrame, keys: list[str]) -> str:
    """An order-free digest of the key columns, from one aggregation."""
    row = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    got = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).first()
    return "-".join(str(x) for x in got)


def write_landing_csv(df: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """Partitioned CSV with a header, rows sorted by key; ValueError if a key repeats."""
    if df.groupBy(partition, *keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"repeated {keys}")
    df.repartition(partition).sortWithinPartitions(partition, *keys).write.mode("overwrite").option("header", "true").partitionBy(partition).csv(path)
