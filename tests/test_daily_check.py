"""The audit of a store, by hand: a clean store gives no issue, each mutation gives its own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith.functions.limits import limit_ratio
from barsmith.functions.scalars import classify_board, normalize_lifecycle_date
from barsmith.operators import daily_check as check
from barsmith.operators import issues

BARS = "code string, trade_date date, open double, high double, low double, close double, pre_close double, volume double, amount double, suspend_flag int"
DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9)]
LIVES = "code string, open_date date, expire_date date, board string, is_st boolean"


def bars(mutations=None, drop=()):
    """Six flat days of three codes; mutations: {(code, day number): {column: value}}."""
    out = []
    for code, price in (("600000.SH", 10.0), ("000001.SZ", 20.0), ("300001.SZ", 30.0)):
        for k, day in enumerate(DAYS):
            if (code, k) in drop:
                continue
            row = {"code": code, "trade_date": day, "open": price, "high": price, "low": price, "close": price, "pre_close": price, "volume": 1000.0,
                "amount": price * 1000.0, "suspend_flag": 0}
            out.append(tuple((row | (mutations or {}).get((code, k), {}))[c.split()[0]] for c in BARS.split(", ")))
    return out


def lives(changes=None):
    base = {"600000.SH": ("main", None), "000001.SZ": ("main", None), "300001.SZ": ("chinext", DAYS[-1])}
    return [(code, *(changes or {}).get(code, (dt.date(2000, 1, 4), end)), board, False) for code, (board, end) in base.items()]


ACTIONS = ("code string, ex_date date, adjustment_factor double, cash_dividend_per_share double, bonus_share_per_share double, "
    "capitalization_per_share double, rights_issue_per_share double, rights_issue_price double")


def found(spark, rows=None, life=None, days=None, actions=(), **settings):
    args = [spark.createDataFrame(rows if rows is not None else bars(), BARS), spark.createDataFrame(life or lives(), LIVES),
        spark.createDataFrame([(d,) for d in (DAYS if days is None else days)], "trade_date date"), spark.createDataFrame(list(actions), ACTIONS)]
    return sorted((r.issue_code, r.code) for r in check.DailyCheck(*args, **settings).run().collect())


C = "600000.SH"


def test_a_clean_store(spark):
    assert found(spark) == []


MOVED = {c: 11.2 for c in ("open", "high", "low", "close")} | {"amount": 11200.0}
#: What is changed on the fourth day (and after), and the issues that follow.
MUTATIONS = [
    ({3: {"open": -1.0, "low": -1.0}}, ["DAILY_NONPOSITIVE_PRICE"]),
    ({3: {"high": 9.0}}, ["DAILY_OHLC_VIOLATION", "DAILY_VWAP_OUT_OF_RANGE"]),
    ({3: {"volume": -5.0}}, ["DAILY_ACTIVE_ZERO_VOLUME", "DAILY_NEGATIVE_QUANTITY"]),
    ({3: {"volume": None, "amount": 0.0}}, ["DAILY_ACTIVE_ZERO_VOLUME"]),
    ({3: {"amount": None}}, ["DAILY_ACTIVE_ZERO_AMOUNT"]),
    ({3: {"suspend_flag": -1}}, ["DAILY_INVALID_SUSPEND_FLAG", "DAILY_SUSPENDED_WITH_TURNOVER"]),
    ({3: {"suspend_flag": 1}}, ["DAILY_SUSPENDED_WITH_TURNOVER"]),
    ({3: {"suspend_flag": 1, "volume": 0.0, "amount": 0.0}}, []),
    ({3: {"amount": 10200.0}}, ["DAILY_VWAP_OUT_OF_RANGE"]),
    ({3: {"pre_close": 10.5}}, ["DAILY_PRE_CLOSE_MISMATCH"]),
    ({3: {"pre_close": 10.005}}, []),
    ({3: {"close": None}}, ["DAILY_NULL_FIELD"]),
    ({3: MOVED, 4: MOVED | {"pre_close": 11.2}, 5: MOVED | {"pre_close": 11.2}}, ["DAILY_PRICE_LIMIT_VIOLATION"]),
]


def test_each_mutation_gives_its_own_issues(spark):
    rows, life = [], []
    for n, (changes, _) in enumerate(MUTATIONS):
        code = f"60{n:04d}.SH"
        for k, day in enumerate(DAYS):
            row = {"code": code, "trade_date": day, "open": 10.0, "high": 10.0, "low": 10.0, "close": 10.0, "pre_close": 10.0, "volume": 1000.0,
                "amount": 10000.0, "suspend_flag": 0} | changes.get(k, {})
            rows.append(tuple(row[c.split()[0]] for c in BARS.split(", ")))
        life.append((code, dt.date(2000, 1, 4), DAYS[-1], "main", False))
    bare = [(*r[:1], *r[1:]) for r in rows if r[0] == "600007.SH"]
    rows += [("600100", *r[1:]) for r in bare] + bare[:1]
    got = {}
    for name, code in found(spark, rows, [*life, ("600100", dt.date(2000, 1, 4), None, "main", False)]):
        got.setdefault(code, []).append(name)
    for n, (_, expected) in enumerate(MUTATIONS):
        extra = ["DAILY_DUPLICATE_KEY"] if n == 7 else []
        assert got.get(f"60{n:04d}.SH", []) == sorted(expected + extra), n
    assert set(got["600100"]) == {"DAILY_CODE_FORMAT_INVALID"}


def test_missing_days_and_codes(spark):
    assert found(spark, bars(drop={("600000.SH", 2), ("600000.SH", 3)}), coverage_threshold=0.5) == [("DAILY_MISSING_SPAN", C)]
    assert [x[0] for x in found(spark, bars(drop={("600000.SH", 2)}))] == ["DAILY_COVERAGE_BELOW_THRESHOLD", "DAILY_MISSING_SPAN"]
    empty_day = {(c, 2) for c in ("600000.SH", "000001.SZ", "300001.SZ")}
    assert [x[0] for x in found(spark, bars(drop=empty_day))] == ["DAILY_CALENDAR_DATE_EMPTY", "DAILY_COVERAGE_BELOW_THRESHOLD", *["DAILY_MISSING_SPAN"] * 3]
    gone = {("300001.SZ", k) for k in range(6)}
    assert ("DAILY_DELISTED_SYMBOL_MISSING", "300001.SZ") in found(spark, bars(drop=gone), coverage_threshold=0.1)


def test_lives(spark):
    assert found(spark, life=lives({C: (DAYS[2], None)})) == [("DAILY_DATA_BEFORE_LISTING", C)] * 2
    assert found(spark, life=lives({C: (dt.date(2000, 1, 4), DAYS[4])})) == [("DAILY_DATA_AFTER_DELISTING", C)]
    assert found(spark, life=lives()[1:]) == [("DAILY_LIFECYCLE_UNKNOWN", C)]
    assert found(spark, life=lives({C: (None, None)})) == [("DAILY_OPEN_DATE_MISSING", C)]
    padded = bars({("600000.SH", 0): {"suspend_flag": 1, "volume": 0.0, "amount": 0.0}})
    assert found(spark, padded, lives({C: (DAYS[1], None)})) == []
    assert ("DAILY_NO_DELISTED_SYMBOLS", None) in found(spark, life=[x[:2] + (None,) + x[3:] for x in lives()])
    assert ("DAILY_INVALID_LIFECYCLE_RANGE", C) in found(spark, life=lives({C: (DAYS[4], DAYS[3])}))


def test_calendar(spark):
    assert found(spark, days=DAYS[:-1], life=lives({"300001.SZ": (dt.date(2000, 1, 4), DAYS[-1])})) == [("DAILY_DATE_NOT_IN_CALENDAR", None)]
    assert found(spark, days=[])[0] == ("DAILY_CALENDAR_UNAVAILABLE", None)


def test_actions(spark):
    ex = {("600000.SH", 3): {"pre_close": 9.52} | {c: 9.52 for c in ("open", "high", "low", "close")} | {"amount": 9520.0},
        **{("600000.SH", k): {c: 9.52 for c in ("open", "high", "low", "close", "pre_close")} | {"amount": 9520.0} for k in (4, 5)}}
    right = [(C, DAYS[3], 10 / 9.52, 0.48, 0.0, 0.0, 0.0, 0.0)]
    assert found(spark, bars(ex), actions=right) == []
    assert found(spark, bars(ex)) == [("DAILY_PRE_CLOSE_MISMATCH", C)]
    assert found(spark, bars(ex), actions=[(C, DAYS[3], 1.2, 0.48, 0.0, 0.0, 0.0, 0.0)]) == [("DAILY_ADJUST_FACTOR_MISMATCH", C)]
    assert found(spark, bars(ex), actions=[(C, DAYS[3], 10 / 9.52, 0.1, 0.0, None, 0.0, 0.0)]) == [("DAILY_ADJUST_THEORY_MISMATCH", C)]
    assert found(spark, actions=[(C, dt.date(2024, 1, 6), 1.1, 0.0, 0.0, 0.0, 0.0, 0.0)]) == [("DAILY_CORPORATE_ACTION_WITHOUT_BAR", C)]


def test_limits_by_date_and_age(spark):
    cases = [
        ("star", dt.date(2019, 7, 19), 100, False, None), ("star", dt.date(2020, 1, 2), 4, False, None), ("star", dt.date(2020, 1, 2), 5, False, 0.2),
        ("star", dt.date(2020, 1, 2), None, False, 0.2),
        ("chinext", dt.date(2020, 8, 21), 3, False, 0.1), ("chinext", dt.date(2020, 8, 21), 0, False, None),
        ("chinext", dt.date(2020, 8, 24), 3, False, None), ("chinext", dt.date(2020, 8, 24), 9, True, 0.2),
        ("chinext", dt.date(2020, 8, 21), 9, True, 0.05), ("bse", dt.date(2024, 1, 2), 0, False, None), ("bse", dt.date(2024, 1, 2), 1, False, 0.3),
        ("main", dt.date(2024, 1, 2), 0, False, None),
        ("main", dt.date(2024, 1, 2), 1, False, 0.1), ("main", dt.date(2024, 1, 2), 1, True, 0.05), ("unknown", dt.date(2024, 1, 2), 100, False, None),
    ]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(cases)], "k int, board string, d date, n int, st boolean, want double")
    for r in df.withColumn("got", limit_ratio(F.col("board"), F.col("d"), F.col("n"), F.col("st"))).collect():
        assert r.got == r.want, r


def test_sessions_since_listing(spark):
    days = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    life = spark.createDataFrame([("A", DAYS[0]), ("B", dt.date(2024, 1, 6)), ("C", None), ("D", dt.date(2024, 3, 1)), ("E", dt.date(2023, 1, 1))],
        "code string, open_date date")
    rows = spark.createDataFrame([(c, DAYS[4]) for c in "ABCDE"] + [("A", dt.date(2024, 1, 6))], "code string, trade_date date")
    got = {(r.code, r.trade_date): r.sessions for r in check.sessions_since_listing(rows, life, days).collect()}
    assert [got[c, DAYS[4]] for c in "ABCDE"] == [4, 0, None, -2, 4] and got["A", dt.date(2024, 1, 6)] is None


def test_settings_are_checked(spark):
    args = [None] * 4
    for bad in ({"coverage_threshold": 0}, {"pre_close_tolerance": -1}, {"limit_level": "INFO"}, {"start": "2024-02-01", "end": "2024-01-01"},
        {"cross_tolerance": 0}):
        with pytest.raises(ValueError):
            check.DailyCheck(*args, **bad)


def test_scope_of_codes_and_dates(spark):
    rows = bars({("600000.SH", 0): {"close": None}, ("000001.SZ", 5): {"suspend_flag": 7}})
    assert {x[0] for x in found(spark, rows, codes=(" 600000.sh ",), coverage_threshold=0.1)} >= {"DAILY_NULL_FIELD"}
    assert ("DAILY_INVALID_SUSPEND_FLAG", "000001.SZ") not in found(spark, rows, start=DAYS[0], end=DAYS[3])


def test_every_level_is_known():
    assert len(issues.LEVELS) == 95 and set(issues.LEVELS.values()) == {"ERROR", "WARNING", "INFO"}
    with pytest.raises(ValueError, match="no issue columns"):
        issues.issue("DAILY_NULL_FIELD", nothing=None)


def test_boards_and_sentinels(spark):
    df = spark.createDataFrame([("688001.SH",), ("688ABC",), ("300750.SZ",), ("430047.BJ",), ("002415.SZ",), ("004001.SZ",), (None,)], "c string")
    assert [r[0] for r in df.select(classify_board(F.col("c"))).collect()] == ["star", "unknown", "chinext", "bse", "main", "unknown", "unknown"]
    df = spark.createDataFrame([("19700101000000",), ("1970-01-06",), ("20240229",), ("2024-02-30",), ("nan",), ("2024",), (None,)], "c string")
    assert [r[0] for r in df.select(normalize_lifecycle_date(F.col("c"))).collect()] == [None, None, dt.date(2024, 2, 29), None, None, None, None]
