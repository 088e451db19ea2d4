"""Queries against their SQL on small tables of events, each planted with what the driver's smaller tables lack."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barsmith.operators import daily_check, landing
from barsmith.plans import self_check


def against_sql(spark, folder, name, events):
    """Rows of a query on events (day, user, type, value, k; one a minute), after comparing them with the rows of its SQL."""
    os.makedirs(folder, exist_ok=True)
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)",
        [(n, f"2024-01-{day:02d} 10:{n % 60:02d}:00", user, kind, value, f'{{"k": {k}}}') for n, (day, user, kind, value, k) in enumerate(events)])
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    got = entry.queries()[name](spark, str(folder))
    cols = got.columns
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(r) for r in got.collect()), key=key)
    b = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert list(map(key, a)) == list(map(key, b)) and a
    return [dict(zip(cols, r, strict=True)) for r in a]


@pytest.mark.parametrize("k, close, expected", [(50, 59.55, "1.2902"), (80, 1.82, "0.8938")])
def test_theory_at_a_tie(spark, tmp_path, k, close, expected):
    rows = against_sql(spark, tmp_path, "audit_adjust_theory", [(1, 1, "click", close, 1), (2, 1, "signup", close, k)])
    assert [(r["code"], r["expected"], r["actual"]) for r in rows] == [("000001.SH", expected, "1.0000")]


def test_price_limit_at_a_tie(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "audit_price_limits", [(1, 1, "click", 8.0, 1), (2, 1, "click", 16.29, 1)])
    assert [(r["code"], r["expected"], r["actual"]) for r in rows] == [("000001.SH", "at most 0.1000", "1.0362")]


def test_price_limit_of_a_day_that_ends_without_a_price(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "audit_price_limits", [(1, 1, "click", 8.0, 1), (2, 1, "click", 12.0, 1), (2, 1, "click", None, 1)])
    assert [(r["code"], r["actual"]) for r in rows] == [("000001.SH", "0.5000")]


def test_price_limit_beside_an_action_without_a_number(spark, tmp_path):
    # the last signup of day 2 gives none, the one before it does: still an action; that of day 3 gives none at all
    events = [(1, 1, "click", 8.0, 1), (2, 1, "signup", 12.0, 1), (2, 1, "signup", 12.0, "null"), (3, 1, "signup", 18.0, "null")]
    rows = against_sql(spark, tmp_path, "audit_price_limits", events)
    assert [(r["trade_date"].day, r["actual"]) for r in rows] == [(3, "0.5000")]


def test_price_limit_of_a_repeated_instrument(spark, tmp_path):
    # both numbers are cut to one code: main since day 1, bse since day 2
    events = [(1, 1_000_001, "click", 8.0, 1), (2, 1_000_003, "click", 16.0, 1), (3, 1_000_001, "click", 8.0, 1)]
    rows = against_sql(spark, tmp_path, "audit_price_limits", events)
    assert sorted((r["trade_date"].day, r["expected"]) for r in rows) == [(2, "at most 0.1000"), (3, "at most 0.1000"), (3, "at most 0.3000")]


def test_price_limit_of_a_huge_move(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "audit_price_limits", [(1, 1, "click", 0.07, 1), (2, 1, "click", 497_093_963_955.1, 1)])
    assert [r["actual"] for r in rows] == ["7101342342214.7128"]


def test_row_without_a_date_is_not_the_row_before(spark):
    bars = spark.createDataFrame([("A", None, 5.0, None, 0), ("A", "2024-01-02", 8.0, None, 0)],
        "code string, trade_date string, close double, pre_close double, suspend_flag int").withColumn("trade_date", F.col("trade_date").cast("date"))
    actions = spark.createDataFrame([], "code string, ex_date date, adjustment_factor double")
    got = daily_check.continuity(bars, actions).collect()
    assert sorted((r["close"], r["previous_close"]) for r in got if r["trade_date"]) == [(8.0, None)]


def test_every_instrument_has_a_life(spark, tmp_path):
    users = [1001, 1005, 1009, 12, 100]
    rows = against_sql(spark, tmp_path, "landing_lifecycle_frame", [(n, u, "click", 5.0, 1) for n, u in enumerate(users, 1)])
    assert len(rows) == len(users) and sum(r["code"] == "600100.SH" for r in rows) == 3


def test_first_row_of_a_repeated_code(spark):
    raw = spark.createDataFrame([("600000.sh", "second", 2), (" 600000.SH", "first", 1), ("", "none", 0)], "code string, instrument_name string, seq long")
    assert [(r.code, r.instrument_name) for r in landing.lifecycle_frame(raw).collect()] == [("600000.SH", "first")]


def test_returns_from_a_price_of_nothing(spark, tmp_path):
    closes = {1: [0.0, 5.0], 2: [0.0], 3: [0.0, 0.0], 4: [2.0, 3.0], 5: [3.0, 0.0], 6: [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0]}
    rows = against_sql(spark, tmp_path, "factors_intraday_path", [(1, u, "click", x, 1) for u, prices in closes.items() for x in prices])
    assert [str(r["last_30m_return"]) for r in rows] == ["inf", "nan", "nan", "0.5", "-1.0", "1.0"]


def test_scope_beyond_a_thousand_codes(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "selfcheck_scope_extra", [(1, u, "click", 5.0, 1) for u in (7, 20, 21, 23, 999, 1000, 1007, 1019, 1021, 2001, 2046)])
    assert [(r["issue_code"], r["actual"]) for r in rows] == [("INSTRUMENT_INFO_OUTSIDE_SCOPE", "5")]


def test_equal_rows_of_lost_codes_all_count(spark, tmp_path):
    # volumes of 59 lose their code, those of 61 get one out of scope
    rows = against_sql(spark, tmp_path, "selfcheck_summary", [(1, u, "click", 5.0, k) for u, k in ((1, 59), (2, 59), (3, 59), (4, 61), (5, 61), (6, 1))])
    assert {r["issue_code"]: r["n"] for r in rows}.items() >= {"KLINE_CODE_MISSING": 3, "KLINE_SYMBOL_OUTSIDE_SCOPE": 2, "KLINE_DUPLICATE_KEY": 5}.items()


def test_price_jump_at_a_tie(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "selfcheck_continuity", [(1, 1, "click", 8.0, 1), (2, 1, "click", 16.29, 1)])
    assert [(r["issue_code"], r["code"], r["actual"]) for r in rows] == [("ABNORMAL_PRICE_JUMP", "C1", "1.0362")]


def test_landed_price_of_three_decimals(spark, tmp_path):
    # a volume of 5 makes pre_close 1.01 times the close before: 0.23735, a tie of the four decimals landed
    rows = against_sql(spark, tmp_path, "selfcheck_continuity", [(1, 1, "click", 0.235, 1), (2, 1, "click", 0.235, 5)])
    assert [(r["issue_code"], r["expected"], r["actual"]) for r in rows] == [("PRE_CLOSE_DISCONTINUITY", "0.2350", "0.2374")]


def test_day_without_a_price_continues_from_those_it_has(spark, tmp_path):
    rows = against_sql(spark, tmp_path, "selfcheck_continuity", [(1, 1, "click", 8.0, 1), (1, 1, "click", None, 1), (2, 1, "click", 16.0, 1)])
    assert [(r["issue_code"], r["actual"]) for r in rows] == [("ABNORMAL_PRICE_JUMP", "1.0000")]


def test_landed_row_without_a_date_is_not_the_row_before(spark, tmp_path):
    rows = [(1, None, 1, "click", 5.0, '{"k": 1}'), (2, dt.datetime(2024, 1, 2, 10), 1, "click", 8.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    got = self_check.landed_once(spark, str(tmp_path)).filter("trade_date IS NOT NULL").collect()
    assert [(r["close"], r["pre_close"]) for r in got] == [("8.0000", "8.0000")]
