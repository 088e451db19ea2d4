import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from barsmith.operators import backtest, market
from barsmith.sources import readers, writers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def day(n):
    return dt.date(2024, 1, n)


@pytest.mark.parametrize("name", ["report_returns", "finance_pit_wide", "experiment_walk_forward", "search_equivalence_dedup", "selfcheck_rows",
    "landing_kline_batch", "bt_random_baseline", "flagship_top_n", "kline_60m", "kline_pre_close_chain", "op_ts_rank", "factors_ma", "auc_tie_aware",
    "bt_drawdown_episodes", "audit_missing_spans", "selfcheck_continuity", "ingest_calendar_accumulate", "finance_pit_asof", "stream_kline"])
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    b = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert len(a) == len(b) and len(a)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or p == pytest.approx(q, rel=1e-6, abs=2e-6)


def test_adjustment_compounds_and_needs_anchor(spark):
    bars = spark.createDataFrame([("A", day(n), 10.0, 10.0, 10.0, 10.0, 5.0) for n in (1, 2, 3, 4)],
        "code string, trade_date date, open double, high double, low double, close double, volume double")
    acts = spark.createDataFrame([("A", day(2), 1.1), ("A", day(4), 1.2), ("A", day(3), -1.0)], "code string, ex_date date, adjustment_factor double")
    got = [round(r.close, 9) for r in market.adjust(bars, acts, "hfq").orderBy("trade_date").collect()]
    assert got == [10.0, 11.0, 11.0, 13.2]
    with pytest.raises(ValueError):
        market.adjust(bars, acts, "qfq")


def test_drawdown_includes_the_start(spark):
    d = spark.createDataFrame([(day(1), -0.1), (day(2), 0.0), (day(3), 0.2)], "target_date date, net double")
    row = backtest.drawdown_episodes(backtest.equity(d)).collect()
    assert len(row) == 1 and row[0].peak_date is None and row[0].recovery_date == day(3) and row[0].days_under == 2


def test_store_round_trip(spark, tmp_path):
    rows = [("A", dt.datetime(2024, m, 1, 9), float(m)) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "code string, trade_time timestamp, close double")
    writers.write_bars(df, str(tmp_path))
    writers.write_bars(df.filter("close = 2").withColumn("close", df.close * 10), str(tmp_path))
    got = readers.read_bars(spark, str(tmp_path), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1, 9))
    assert [r.close for r in got.collect()] == [20.0]
    assert readers.read_bars(spark, str(tmp_path), dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1, 9), closed=True).count() == 2


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_broken_bars_raise_or_go(spark):
    schema = "code string, trade_date date, open double, high double, low double, close double, volume long"
    rows = [("A", day(1), 1.0, 2.0, 1.0, 2.0, 5), ("A", day(2), 1.0, 2.0, 0.0, 2.0, 5), ("A", day(3), 1.0, 1.5, 1.0, 2.0, 5),
        ("A", day(4), 1.0, 2.0, 1.0, 2.0, -1), ("A", day(5), None, 2.0, 1.0, 2.0, 5), ("A", day(6), 1.0, 2.0, 1.0, 2.0, None)]
    bars = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match="5 rows"):
        readers.validated(bars)
    assert [r.trade_date for r in readers.validated(bars, broken="drop").collect()] == [day(1)]
    with pytest.raises(ValueError, match="raise or drop"):
        readers.validated(bars, broken="keep")
    with pytest.raises(ValueError, match="repeated"):
        readers.validated(bars.unionAll(bars), broken="drop")
    assert readers.validated(bars.limit(0)).count() == 0
