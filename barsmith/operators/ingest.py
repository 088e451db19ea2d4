"""Landing rows to store rows: classification, overrides, corrections, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_number

#: Reasons in the order in which they are tested.
REASONS = ["trade_date_null", "trade_date_bad_length", "trade_date_unparsable", "unknown_code", "before_listing_padding", "before_listing_with_data",
    "after_delisting", "kept"]


def classify(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """rows (code, trade_date as yyyyMMdd text, volume) with parsed_date and reason; a changed lifecycle table is joined by code."""
    life = instruments.select(F.col("code").alias("__code"), "open_date", "expire_date")
    x = rows.join(life, F.col("code") == F.col("__code"), "left").withColumn("parsed_date",
        F.try_to_date(F.when(F.length("trade_date") == 8, F.col("trade_date")), "yyyyMMdd"))
    reason = (
        F.when(F.col("trade_date").isNull(), REASONS[0]).when(F.length("trade_date") != 8, REASONS[1]).when(F.col("parsed_date").isNull(),
        REASONS[2]).when(F.col("__code").isNull(), REASONS[3])
        .when((F.col("parsed_date") < F.col("open_date")) & (F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) == 0),
        REASONS[4]).when(F.col("parsed_date") < F.col("open_date"), REASONS[5])
        .when(F.col("parsed_date") > F.col("expire_date"), REASONS[6]).otherwise(REASONS[7])
    )
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], "parsed_date", reason.alias("reason"))


def reason_counts(classified: DataFrame) -> DataFrame:
    """One row per reason, zero-filled."""
    spark = classified.sparkSession
    every = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    return every.join(classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def reason_samples(classified: DataFrame, limit: int = 10, seed: int = 1) -> DataFrame:
    """At most `limit` rows per reason other than kept, by hash order; each task keeps no more of a reason before the shuffle."""
    order = Window.partitionBy("reason").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "code", "trade_date")), "code", "trade_date", "volume")
    return classified.filter("reason <> 'kept'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).drop("k")


def override(bars: DataFrame, errata: DataFrame, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume", "amount")) -> DataFrame:
    """Cell overrides from errata (code, trade_date, field, value); the last text wins per cell."""
    wide = errata.groupBy("code", "trade_date").pivot("field", list(fields)).agg(F.max(finite_number(F.col("value"))))
    wide = wide.select("code", "trade_date", *(F.col(f).alias(f"__{f}") for f in fields))
    x = bars.join(wide, ["code", "trade_date"], "left")
    return x.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in bars.columns])


def correct_prices(bars: DataFrame) -> DataFrame:
    """high raised to max(open, close, low), then low lowered to min(open, close, new high); corrected flags what changed."""
    high = F.greatest("open", "close", "low", "high")
    low = F.least(F.col("open"), F.col("close"), high, F.col("low"))
    out = bars.withColumn("corrected", F.concat_ws(",", F.when(high != F.col("high"), "high"), F.when(low != F.col("low"), "low")))
    return out.withColumns({"high": high, "low": low})


def missing_pairs(codes: DataFrame, dates: DataFrame, bars: DataFrame) -> DataFrame:
    """codes x dates without a bar: each code explodes the one array of dates, and existing pairs are anti-joined by key."""
    days = dates.agg(F.sort_array(F.collect_set("trade_date")).alias("days"))
    pairs = codes.select("code").distinct().crossJoin(F.broadcast(days)).select("code", F.explode("days").alias("trade_date"))
    return pairs.join(bars.select("code", "trade_date"), ["code", "trade_date"], "left_anti")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], removed: DataFrame | None = None) -> DataFrame:
    """state with rows of changes in place of those of equal keys, and without the keys in removed."""
    out = state.join(changes, keys, "left_anti").unionByName(changes)
    return out if removed is None else out.join(removed, keys, "left_anti")


def changed_partitions(before: DataFrame, now: DataFrame) -> DataFrame:
    """name, change (dirty, refreshed, removed) of partitions by fingerprint (bytes, sha256): refreshed has equal content, new stat."""
    x = before.select("name", F.col("bytes").alias("b0"),
        F.col("sha256").alias("h0")).join(now.select("name", F.col("bytes").alias("b1"), F.col("sha256").alias("h1")), "name", "full")
    change = F.when(F.col("h1").isNull(), "removed").when(F.col("h0").isNull() | (F.col("h0") != F.col("h1")),
        "dirty").when(F.col("b0") != F.col("b1"), "refreshed")
    return x.select("name", change.alias("change")).filter("change IS NOT NULL")


def accumulate_calendar(snapshots: DataFrame) -> DataFrame:
    """trade_date, calendar_symbol from snapshots (trade_date as yyyyMMdd text, calendar_symbol, seq): unparsable dates go, the latest symbol wins."""
    day = F.try_to_date(F.when(F.length("trade_date") == 8, F.col("trade_date")), "yyyyMMdd")
    return snapshots.select(day.alias("trade_date"), "calendar_symbol",
        "seq").filter("trade_date IS NOT NULL").groupBy("trade_date").agg(F.max_by("calendar_symbol", "seq").alias("calendar_symbol"))
