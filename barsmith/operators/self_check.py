"""Audit of landed daily rows (all text) against their partitions, lives and calendar: issues of the one shape.

rows: partition_date (yyyyMMdd), the ten kline columns as text, source_file, source_row. Row rules are
tried in one scan; a row that fails to be placed (no code, out of scope, wrong date) is not judged further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_number, is_date_sentinel, normalize_date, ratio
from .daily_check import coverage, expected_bars, missing_span_issues, missing_spans
from .issues import issue, said, said_all, union

c = F.col
DATASET = "kline_1d"
NUMBERS = ["open", "high", "low", "close", "pre_close", "volume", "amount", "suspend_flag"]
COLUMNS = ["code", "trade_date", *NUMBERS]


def column_issues(names: list[str], rows: DataFrame) -> DataFrame:
    """One issue per partition of rows whose file lacks required columns (names: those it has)."""
    missing = sorted(set(COLUMNS) - set(names))
    parts = rows.select("partition_date").distinct()
    text = F.lit(", ".join(missing))
    found = parts.select(*issue("KLINE_COLUMNS_MISSING", DATASET, trade_date=F.try_to_date("partition_date", "yyyyMMdd"),
        expected=", ".join(sorted(COLUMNS)), actual=text))
    return found if missing else found.limit(0)


def day(text: Column) -> Column:
    """A date from any of the accepted texts, NULL for sentinels and others."""
    clean = F.lower(F.trim(text))
    return F.when(~clean.isin("", "nan", "nat", "none", "99999999", "0"), F.try_to_date(normalize_date(text), "yyyyMMdd"))


def prepared(rows: DataFrame) -> DataFrame:
    """rows with raw texts as r_*, numbers, code in upper case, part_date and row_date."""
    out = rows.select("*", *[c(n).alias(f"r_{n}") for n in NUMBERS])
    return out.withColumns({n: finite_number(c(n)) for n in NUMBERS} | {"code": F.upper(F.trim("code")),
        "part_date": F.try_to_date("partition_date", "yyyyMMdd"), "row_date": day(c("trade_date"))})


# ---- lives


def lifecycle(instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """code, open_date, expire_date and what is odd about them, from landed rows (code, open_date, expire_date as text, seq); the first row of a code counts."""
    by = Window.partitionBy("code").orderBy("seq")
    first = calendar.agg(F.min("trade_date").alias("first"))
    i = instruments.withColumn("code", F.upper(F.trim("code"))).withColumn("place", F.row_number().over(by)).withColumn("rows",
        F.count(F.lit(1)).over(Window.partitionBy("code")))
    for name in ("open_date", "expire_date"):
        raw = c(f"r_{name}")
        i = i.withColumnRenamed(name, f"r_{name}").withColumn(name, F.when(~is_date_sentinel(raw), day(raw))).withColumn(f"{name}_invalid",
            ~is_date_sentinel(raw) & c(name).isNull())
    i = i.withColumn("open_missing", c("open_date").isNull())
    return i.crossJoin(F.broadcast(first)).withColumn("open_date", F.coalesce("open_date", "first")).drop("first")


def lifecycle_issues(life: DataFrame) -> DataFrame:
    """Of lifecycle(): repeated codes (each row), unparsable and missing dates, ends before beginnings (first rows)."""
    one = life.filter("place = 1")
    say = lambda df, name, **k: df.select(*issue(name, "instrument_info", code=c("code"), source_row=c("seq"), **k))
    dates = F.concat(c("open_date").cast("string"), F.lit(" > "), c("expire_date").cast("string"))
    return union(
        say(life.filter("rows > 1"), "INSTRUMENT_INFO_DUPLICATE", expected="one row a code", actual=c("rows").cast("string")),
        say(one.filter("open_date_invalid"), "OPEN_DATE_INVALID", field="open_date", actual=c("r_open_date")),
        say(one.filter("expire_date_invalid"), "EXPIRE_DATE_INVALID", field="expire_date", actual=c("r_expire_date")),
        say(one.filter("open_missing"), "OPEN_DATE_MISSING", field="open_date", actual=c("r_open_date")),
        say(one.filter("open_date > expire_date"), "INVALID_LIFECYCLE_RANGE", field="open_date,expire_date", actual=dates),
    )


def scope_issues(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """The declared codes against those of the instrument snapshot: none at all, some without a life, some beyond the scope."""
    known = instruments.select(F.upper(F.trim("code")).alias("code")).distinct()
    absent = symbols.join(known, "code", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("x"))
    extra = known.join(symbols, "code", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("x"))
    none = symbols.agg(F.count(F.lit(1)).alias("n"))
    say = lambda df, test, name: df.filter(test).select(*issue(name, "instrument_info", actual=c("n").cast("string"),
        evidence=c("x") if "x" in df.columns else None))
    return union(say(none, "n = 0", "EXPECTED_SYMBOLS_EMPTY"), say(absent, "n > 0", "SYMBOLS_MISSING_INSTRUMENT_INFO"),
        say(extra, "n > 0", "INSTRUMENT_INFO_OUTSIDE_SCOPE"))


# ---- rows


def placed(ready: DataFrame, symbols: DataFrame, life: DataFrame) -> DataFrame:
    """prepared() rows with in_scope, open_date, expire_date, problem (why a row can't be placed) and alive."""
    scope = symbols.select("code").distinct().withColumn("in_scope", F.lit(True))
    spans = life.filter("place = 1").select("code", "open_date", "expire_date") if "place" in life.columns else life.select("code", "open_date", "expire_date")
    x = ready.join(scope, "code", "left").join(spans, "code", "left").withColumn("open_date", F.coalesce("open_date", "part_date"))
    missing = F.coalesce(F.lower("code").isin("", "nan"), F.lit(True))
    problem = (
        F.when(missing, "KLINE_CODE_MISSING").when(c("in_scope").isNull(),
        "KLINE_SYMBOL_OUTSIDE_SCOPE").when(~F.coalesce(c("row_date") == c("part_date"), F.lit(False)), "KLINE_DATE_PARTITION_MISMATCH")
    )
    x = x.withColumn("problem", problem)
    inside = (c("part_date") >= c("open_date")) & (c("expire_date").isNull() | (c("part_date") <= c("expire_date")))
    return x.withColumn("alive", c("problem").isNull() & inside)


def _row(name: str | Column, **values) -> list[Column]:
    level = None if isinstance(name, str) else "ERROR"
    return issue(name, DATASET, level, code=c("code"), trade_date=c("part_date"), source_file=c("source_file"), source_row=c("source_row"), **values)


def row_issues(rows: DataFrame) -> DataFrame:
    """Issues of single placed() rows, in one scan."""
    finite = F.lit(True)
    for n in NUMBERS:
        finite &= c(n).isNotNull()
    judged = c("alive") & finite
    ohlc = said_all(*[(n, c(n)) for n in ("open", "high", "low", "close")])
    turnover = said_all(("volume", c("volume")), ("amount", c("amount")))
    wrong = F.when(c("problem") == "KLINE_DATE_PARTITION_MISMATCH", c("trade_date")).otherwise(c("code"))
    active, suspended = c("suspend_flag") == 0, c("suspend_flag") == 1
    rules = [
        (c("problem").isNotNull(), _row(c("problem"), field=F.when(c("problem") == "KLINE_DATE_PARTITION_MISMATCH", "trade_date").otherwise("code"),
        actual=wrong)),
        *[(c("alive") & c(n).isNull(), _row("KLINE_FIELD_INVALID", field=n, expected="a finite number", actual=c(f"r_{n}"))) for n in NUMBERS],
        (judged & ((c("high") < F.greatest("open", "low", "close")) | (c("low") > F.least("open", "high", "close"))),
        _row("INVALID_OHLC_RELATION", field="open,high,low,close", actual=ohlc)),
        (judged & ((c("volume") < 0) | (c("amount") < 0)), _row("NEGATIVE_TURNOVER", field="volume,amount", actual=turnover)),
        (judged & ~c("suspend_flag").isin(0, 1), _row("INVALID_SUSPEND_FLAG", field="suspend_flag", actual=said(c("suspend_flag")))),
        (judged & active & (c("volume") <= 0), _row("ACTIVE_ZERO_VOLUME", field="volume", actual=turnover)),
        (judged & active & (c("amount") <= 0), _row("ACTIVE_ZERO_AMOUNT", field="amount", actual=turnover)),
        (judged & suspended & ((c("volume") != 0) | (c("amount") != 0)), _row("SUSPENDED_WITH_TURNOVER", field="suspend_flag,volume,amount", actual=turnover)),
        (judged & suspended & ~((c("open") == c("high")) & (c("high") == c("low")) & (c("low") == c("close"))),
        _row("SUSPENDED_PRICE_NOT_FLAT", field="open,high,low,close", actual=ohlc)),
    ]
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(test, F.struct(*columns)) for test, columns in rules]))).alias("x")).select("x.*")


def duplicate_issues(ready: DataFrame) -> DataFrame:
    """Each row of a (code, trade_date) that a partition has twice or more."""
    keys = ready.groupBy("partition_date", "code", "trade_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = ready["partition_date"].eqNullSafe(keys["partition_date"]) & ready["code"].eqNullSafe(keys["code"]) & ready["trade_date"].eqNullSafe(
        keys["trade_date"])
    return ready.join(keys, same, "left_semi").select(*_row("KLINE_DUPLICATE_KEY", field="code,trade_date", expected="one row"))


def outside_life_issues(rows: DataFrame) -> DataFrame:
    """The first placed row of a code before its listing (suspended placeholders aside) and the first after its end."""
    before = (c("part_date") < c("open_date")) & (F.coalesce(c("suspend_flag"), F.lit(0.0)) != 1)
    name = F.when(before, "DATA_BEFORE_LISTING").when(c("part_date") > c("expire_date"), "DATA_AFTER_DELISTING")
    x = rows.filter("problem IS NULL").withColumn("name", name).filter("name IS NOT NULL")
    first = x.groupBy("code", "name").agg(F.min("part_date").alias("part_date"), F.min("open_date").alias("open_date"),
        F.min("expire_date").alias("expire_date"))
    limit = F.when(c("name") == "DATA_BEFORE_LISTING", c("open_date")).otherwise(c("expire_date")).cast("string")
    return first.select(*issue(c("name"), DATASET, "ERROR", code=c("code"), trade_date=c("part_date"), field="trade_date", expected=limit,
        actual=c("part_date").cast("string")))


def continuity_issues(rows: DataFrame, actions: DataFrame, jump: float = 0.5, scale: float = 100.0, window: int = 20, least: int = 10) -> DataFrame:
    """Of rows alive, in date order: pre_close off the last row's close, jumps from pre_close, volumes far from the median of the last valid ones.

    A volume is valid if it is above 0 and the row is not suspended; the median is of up to `window` valid ones before, at least `least`.
    """
    alive = rows.filter("alive")
    order = Window.partitionBy("code").orderBy("part_date", "source_file", "source_row")
    acts = actions.select("code", c("ex_date").alias("part_date")).distinct().withColumn("explained", F.lit(True))
    x = alive.withColumn("before", F.lag("close").over(order)).join(acts, ["code", "part_date"], "left")
    nonzero = lambda n: F.coalesce(c(n) != 0, F.lit(False))
    broken = nonzero("pre_close") & nonzero("before") & (F.abs(ratio(c("pre_close"), c("before")) - 1) > 1e-6)
    moved = ratio(c("close"), c("pre_close")) - 1
    name = F.when(c("explained"), "PRE_CLOSE_DISCONTINUITY_EXPLAINED").otherwise("PRE_CLOSE_DISCONTINUITY")
    breaks = x.filter(broken).select(*issue(name, DATASET, "INFO", code=c("code"), trade_date=c("part_date"), field="pre_close",
        expected=said(c("before")), actual=said(c("pre_close"))))
    jumps = alive.filter(nonzero("close") & nonzero("pre_close") & (F.abs(moved) > jump)).select(*issue("ABNORMAL_PRICE_JUMP", DATASET,
        code=c("code"), trade_date=c("part_date"), field="close,pre_close", actual=said(moved)))
    past = order.rowsBetween(-window, -1)
    valid = alive.filter((c("volume") > 0) & (c("suspend_flag") == 0))
    v = valid.withColumn("n", F.count(F.lit(1)).over(past)).withColumn("median", F.percentile("volume", 0.5).over(past)).filter(c("n") >= least)
    v = v.withColumn("times", F.greatest(ratio(c("volume"), c("median")), ratio(c("median"), c("volume"))))
    scales = v.filter(c("times") >= scale).select(*issue("ABNORMAL_VOLUME_SCALE", DATASET, code=c("code"), trade_date=c("part_date"), field="volume",
        expected=said(c("median")), actual=said(c("volume"))))
    return union(breaks, jumps, scales)


# ---- calendar


def scan_issues(rows: DataFrame, partitions: DataFrame, life: DataFrame, symbols: DataFrame, calendar: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Days without a partition or off the calendar, codes missing on a day, thin days, missing spans, codes without any row.

    partitions: part_date of those that exist.
    """
    days = calendar.select("trade_date").distinct()
    lives = symbols.select("code").distinct().join(life.filter("place = 1").select("code", "open_date", "expire_date"), "code", "left")
    expected = expected_bars(lives, days)
    present = rows.filter("problem IS NULL").select("code", c("part_date").alias("trade_date")).distinct()
    by_date, by_code = coverage(expected, present, "trade_date"), coverage(expected, present, "code")
    spans = missing_spans(expected, present)
    ends = expected.groupBy("code").agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    have = partitions.select(c("part_date").alias("trade_date")).distinct()
    gap = by_date.filter("missing_rows > 0")
    share = F.concat(c("actual_rows").cast("string"), F.lit("/"), c("expected_rows").cast("string"))
    return union(
        days.join(have, "trade_date", "left_anti").select(*issue("MISSING_DATE_PARTITION", DATASET, trade_date=c("trade_date"))),
        have.join(days, "trade_date", "left_anti").select(*issue("DATA_ON_NON_TRADING_DATE", DATASET, trade_date=c("trade_date"))),
        gap.select(*issue("DATE_SYMBOLS_MISSING", DATASET, trade_date=c("trade_date"), actual=share)),
        by_date.filter(c("coverage") < threshold).select(*issue("LOW_DATE_COVERAGE", DATASET, trade_date=c("trade_date"), actual=share)),
        missing_span_issues(spans, "KLINE_MISSING_SPAN").withColumn("dataset", F.lit(DATASET)),
        by_code.filter("actual_rows = 0").join(ends, "code").select(*issue("SYMBOL_ALL_DATA_MISSING", DATASET, code=c("code"), start_date=c("lo"),
        end_date=c("hi"), expected=c("expected_rows").cast("string"), actual="0")),
    )


def symbol_statistics(rows: DataFrame, life: DataFrame, symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per code: expected, actual, missing rows, coverage, and rows suspended or active without volume."""
    days = calendar.select("trade_date").distinct()
    lives = symbols.select("code").distinct().join(life.filter("place = 1").select("code", "open_date", "expire_date"), "code", "left")
    here = rows.filter("problem IS NULL")
    counted = here.filter("alive").groupBy("code").agg(
        F.sum(F.when(c("suspend_flag") == 1, 1).otherwise(0)).alias("suspended_rows"),
        F.sum(F.when((c("suspend_flag") == 0) & (c("volume") <= 0), 1).otherwise(0)).alias("active_zero_volume_rows")
    )
    out = coverage(expected_bars(lives, days), here.select("code", c("part_date").alias("trade_date")).distinct(), "code").join(counted, "code", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("suspended_rows", "active_zero_volume_rows")})


def run(rows: DataFrame, instruments: DataFrame, symbols: DataFrame, calendar: DataFrame, actions: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Every rule over landed rows: one issue frame."""
    life = lifecycle(instruments, calendar)
    ready = prepared(rows)
    seen = placed(ready, symbols, life)
    return union(
        lifecycle_issues(life), scope_issues(symbols, instruments), row_issues(seen), duplicate_issues(ready), outside_life_issues(seen),
        continuity_issues(seen, actions), scan_issues(seen, ready.select("part_date"), life, symbols, calendar, threshold),
    )
