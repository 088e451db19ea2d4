"""Finance statements: raw vendor records to rows, issues about them, and what was visible on each trading day.

records: code, table, key (the vendor's record key), field, value, all text. Each table's first two fields are its
report and announcement date; the others are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_number, normalize_date
from .issues import issue, union

c = F.col


def parse(records: DataFrame, table: str, report: str, announce: str, values: list[str]) -> DataFrame:
    """code, report_date (the record key's where the field has none), announce_date, values of one table; records without any report date are left out."""
    wide = records.filter(c("table") == table).groupBy("code", "key").pivot("field", [report, announce, *values]).agg(F.max("value"))
    out = wide.select(
        "code", F.coalesce(normalize_date(c(f"`{report}`")), normalize_date(c("key"))).alias("report_date"),
        normalize_date(c(f"`{announce}`")).alias("announce_date"), *[finite_number(c(f"`{v}`")).alias(v) for v in values]
    )
    return out.filter("report_date IS NOT NULL")


def parse_issues(records: DataFrame, codes: DataFrame, table: str, report: str, values: list[str], parsed: DataFrame) -> DataFrame:
    """Warnings: codes without records, records without a report date or an announcement, with all or some values missing."""
    mine = records.filter(c("table") == table)
    raw = f"finance_raw/{table}"
    keys = mine.groupBy("code", "key").agg(F.max(F.when(c("field") == report, c("value"))).alias("r"))
    lost = keys.filter(F.coalesce(normalize_date(c("r")), normalize_date(c("key"))).isNull())
    missing = F.array_compact(F.array(*[F.when(c(v).isNull(), F.lit(v)) for v in values]))
    held = parsed.withColumn("missing", missing)
    say = lambda df, field, dataset=raw, **k: df.select(*issue(F.lit("FINANCE_RECORD"), dataset, "WARNING", code=c("code"), field=field, **k))
    some = (F.size("missing") > 0) & (F.size("missing") < len(values))
    return union(
        say(codes.join(mine.select("code").distinct(), "code", "left_anti"), "record", actual="none"),
        say(lost, "report_date", actual=c("key")),
        say(held.filter("announce_date IS NULL"), "announce_date", actual=c("report_date")),
        say(held.filter(F.size("missing") == len(values)), "values", actual=F.array_join("missing", ","), expected=c("report_date")),
        say(held.filter(some), "values", dataset=f"finance_field/{table}", actual=F.array_join("missing", ","), expected=c("report_date")),
    )


def raw_partitions(parsed: DataFrame) -> DataFrame:
    """parsed with the announcement date it is filed under: "unknown" where there is none."""
    return parsed.withColumn("partition", F.coalesce("announce_date", F.lit("unknown")))


def daily_columns(tables: dict[str, list[str]]) -> list[str]:
    """Columns of point_in_time(): by table name, its dates, then its values."""
    return ["code", "trade_date", *[f"{t}_{x}" for t in sorted(tables) for x in ("report_date", "announce_date", *tables[t])], "has_finance"]


def point_in_time(parsed: dict[str, DataFrame], values: dict[str, list[str]], pairs: DataFrame) -> DataFrame:
    """pairs (code, trade_date as yyyyMMdd) with each table's visible record: of those announced strictly before, the largest
    report date, the later announcement on ties; has_finance if any table has one.

    Records of all tables and the pairs run through one window per code: a running maximum for each table.
    """
    names = sorted(parsed)
    rows = pairs.select("code", c("trade_date").alias("at"), F.lit(0).alias("kind"))
    for t in names:
        key = F.struct("report_date", "announce_date", *values[t])
        rows = rows.unionByName(parsed[t].filter("announce_date IS NOT NULL").select("code", c("announce_date").alias("at"), F.lit(1).alias("kind"),
            key.alias(f"r_{t}")), allowMissingColumns=True)
    upto = Window.partitionBy("code").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({f"b_{t}": F.max(f"r_{t}").over(upto) for t in names}).filter("kind = 0")
    any_seen: Column = F.lit(False)
    for t in names:
        any_seen |= c(f"b_{t}").isNotNull()
    return seen.select("code", c("at").alias("trade_date"),
        *[c(f"b_{t}.{x}").alias(f"{t}_{x}") for t in names for x in ("report_date", "announce_date", *values[t])], any_seen.cast("int").alias("has_finance"))


def daily_issues(daily: DataFrame) -> DataFrame:
    return daily.filter("has_finance = 0").select(*issue(F.lit("FINANCE_DAILY"), "finance_daily", "WARNING", code=c("code"),
        trade_date=F.try_to_date("trade_date", "yyyyMMdd"), actual="no visible record"))
