"""Scans with pruning and validation."""

from __future__ import annotations

import csv
import datetime as dt
import io
import itertools
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars(spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None, codes: list[str] | None = None,
    closed: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Bars of a year=/month= store: [start, end) or, if closed, [start, end]; the range also prunes partitions.

    Months written at different times may differ in columns: give the schema then (columns a month lacks are NULL), so that no footers are read to find it.
    """
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if {"year", "month"} <= set(df.columns):
        month = F.col("year") * 12 + F.col("month")
        if start:
            df = df.filter(month >= start.year * 12 + start.month)
        if end:
            df = df.filter(month <= end.year * 12 + end.month)
    if start:
        df = df.filter(F.col("trade_time") >= F.lit(start))
    if end:
        df = df.filter(F.col("trade_time") <= F.lit(end) if closed else F.col("trade_time") < F.lit(end))
    return df if codes is None else df.filter(F.col("code").isin(codes))


def read_landing_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Landing partitions: every column as text, in a fixed schema; partition columns come from the folder names."""
    return spark.read.option("header", "true").schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def read_zipped_csv(spark: SparkSession, pattern: str, columns: list[str], encoding: str = "utf-8-sig") -> DataFrame:
    """Rows of every CSV member of the zip files that match: all text, with archive and member. Archives are opened on executors, one at a time and
    member by member."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in archive.infolist():
                        if member.is_dir() or not member.filename.lower().endswith(".csv"):
                            continue
                        with archive.open(member) as stream:
                            rows = csv.DictReader(io.TextIOWrapper(stream, encoding))
                            for part in iter(lambda: list(itertools.islice(rows, 10_000)), []):
                                arrays = [pa.array([r.get(n) for r in part], pa.string()) for n in columns]
                                names = [pa.array([x] * len(part), pa.string()) for x in (path.rsplit("/", 1)[-1], member.filename)]
                                yield pa.RecordBatch.from_arrays([*arrays, *names], [*columns, "archive", "member"])

    return raw.mapInArrow(run, ", ".join(f"`{n}` string" for n in [*columns, "archive", "member"]))


def normalised_bars(raw: DataFrame) -> DataFrame:
    """Vendor minute rows, all text (code, trade_time as yyyy-MM-dd HH:mm[:ss] or yyyyMMddHHmm[ss], prices, volume, amount), as the store has them:
    times parsed, volume rounded, unparsable values NULL."""
    text = F.regexp_replace(F.col("trade_time"), "[^0-9]", "")
    time = F.try_to_timestamp(F.rpad(F.when(F.length(text) >= 12, text), 14, "0"), F.lit("yyyyMMddHHmmss"))
    number = lambda n: F.col(n).cast("string").try_cast("double").alias(n)
    out = raw.select(F.upper(F.trim("code")).alias("code"), time.alias("trade_time"), *map(number, ("open", "high", "low", "close")),
        F.round(F.col("volume").cast("string").try_cast("double")).cast("long").alias("volume"), number("amount"))
    return out.filter("code <> '' AND trade_time IS NOT NULL").withColumn("trade_date", F.to_date("trade_time"))


def partition_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below path, for verification against markers."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"))


def broken_bar() -> Column:
    """Whether a row breaks the bar contract: missing or non-positive prices, negative volume, inconsistent high or low; never NULL."""
    prices = ("open", "high", "low", "close")
    bad = (F.col("volume") < 0) | (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    for c in (*prices, "volume"):
        bad |= F.col(c).isNull()
    for c in prices:
        bad |= F.col(c) <= 0
    return F.coalesce(bad, F.lit(True))


def invalid_bars(bars: DataFrame) -> DataFrame:
    """Rows that break the bar contract."""
    return bars.filter(broken_bar())


def validated(bars: DataFrame, key: tuple[str, ...] = ("code", "trade_date"), broken: str = "raise") -> DataFrame:
    """bars, or ValueError if any row breaks the contract (with broken="drop" such rows go) or a key repeats (one aggregation each)."""
    if broken not in ("raise", "drop"):
        raise ValueError("broken is raise or drop")
    if broken == "drop":
        bars = bars.filter(~broken_bar())
    elif n := invalid_bars(bars).count():
        raise ValueError(f"{n} rows break the bar contract")
    if bars.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"repeated {key}")
    return bars
