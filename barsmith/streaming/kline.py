"""Streaming K-lines: the batch resampling as a watermarked aggregation, kept in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.market import MINUTES


def stream_kline(bars: DataFrame, period: str, lateness: str = "1 day") -> DataFrame:
    """Streaming bars (code, trade_time, seq, open, high, low, close, volume) to K-lines; rows later than `lateness` are dropped."""
    order = F.struct("trade_time", "seq")
    agg = bars.withWatermark("trade_time", lateness).groupBy("code", F.window("trade_time", MINUTES[period]).alias("w")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume")
    )
    return agg.select("code", F.col("w.start").alias("bucket"), "open", "high", "low", "close", F.round("volume").cast("long").alias("volume"))


def run_available(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    """Run on all input that is there and return the K-lines so far.

    Each micro-batch writes the lines it changed below path, under its own number, and a checkpoint makes a rerun go on
    where the last one stopped; a batch that is run again overwrites its own folder. The newest state of a line counts.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/lines/batch={batch}")

    query = lines.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    names = [f.name for f in lines.schema.fields]
    written = spark.read.schema(lines.schema.add("batch", "long")).option("basePath", f"{path}/lines").parquet(f"{path}/lines")
    rest = F.struct(*[n for n in names if n not in ("code", "bucket")])
    return written.groupBy("code", "bucket").agg(F.max_by(rest, "batch").alias("x")).select("code", "bucket", "x.*")
