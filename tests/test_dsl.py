import datetime as dt

import pytest

from barsmith.functions import dsl


def frame(spark, closes, code="A"):
    rows = [(code, dt.date(2024, 1, 1) + dt.timedelta(i), c, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "code string, trade_date date, open double, close double, volume double")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("code", "trade_date").collect()]


def test_parse_round_trip_and_identity():
    n = dsl.parse("cs_rank(ts_mean(close, window=3)) - 1")
    assert dsl.parse(n.canonical) == n
    assert dsl.Node.from_dict(n.to_dict()) == n
    assert n.identity.startswith("fg_") and n.lookback == 2 and n.depth == 4 and n.columns == {"close"}


@pytest.mark.parametrize("bad", ["close ** 2", "__import__('os')", "delay(close, periods=-1)", "ts_mean(close, window=0)",
    "ts_mean(close, window=2, min_periods=3)", "nothing(close)", "close.x", "x" * 20_001])
def test_refused(bad):
    with pytest.raises((ValueError, RecursionError)):
        dsl.parse(bad)


def test_missing_values(spark):
    df = frame(spark, [1.0, None, float("nan"), 4.0])
    assert values(dsl.evaluate(df, {"x": "not_equal(close, 1)"})) == [0.0, 0.0, 0.0, 1.0]
    assert values(dsl.evaluate(df, {"x": "close / (close - close)"})) == [None] * 4
    assert values(dsl.evaluate(df, {"x": "ts_sum(close, window=4, min_periods=2)"})) == [None, None, None, 5.0]


def test_windows(spark):
    df = frame(spark, [3.0, 1.0, 2.0, 2.0, 5.0])
    assert values(dsl.evaluate(df, {"x": "ts_argmax(close, window=3)"})) == [None, None, 1.0, 2.0, 3.0]
    assert values(dsl.evaluate(df, {"x": "ts_rank(close, window=3)"})) == [None, None, pytest.approx(2 / 3), pytest.approx(2.5 / 3), 1.0]
    assert values(dsl.evaluate(df, {"x": "ts_correlation(close, volume, window=3)"})) == [None] * 5


def test_future_does_not_change_history(spark):
    a, b = frame(spark, [1.0, 2.0, 3.0, 4.0]), frame(spark, [1.0, 2.0, 3.0, 400.0])
    e = {"x": "returns(ts_mean(close, window=2), periods=1)"}
    assert values(dsl.evaluate(a, e))[:3] == values(dsl.evaluate(b, e))[:3]


def test_cross_section_ties(spark):
    df = frame(spark, [1.0]).unionByName(frame(spark, [1.0], "B")).unionByName(frame(spark, [3.0], "C")).unionByName(frame(spark, [None], "D"))
    assert values(dsl.evaluate(df, {"x": "cs_rank(close)"})) == [0.5, 0.5, 1.0, None]


def test_odd_column_names_have_ids_of_their_own(spark):
    odd, plain = dsl.column("add(close, open)"), dsl.parse("add(close, open)")
    assert odd.canonical == "column('add(close, open)')" and odd.identity != plain.identity and dsl.parse(odd.canonical) == odd
    assert dsl.column("class").canonical == "column('class')" and dsl.column("close").canonical == "close"
    df = frame(spark, [1.0, 2.0]).withColumnRenamed("volume", "add(close, open)")
    assert values(dsl.evaluate(df, {"x": odd, "y": plain}), "x") == [10.0, 10.0]


def test_json_round_trip():
    n = dsl.parse("where(close > ts_mean(close, window=3), power(open, exponent=2), 0.5)")
    assert dsl.Node.from_json(n.to_json()) == n
    with pytest.raises(ValueError, match="takes"):
        dsl.Node.from_dict({"operator": "add", "inputs": [{"operator": "column", "inputs": [], "parameters": {"name": "close"}}], "parameters": {}})


def test_what_looks_ahead_is_not_evaluated(spark):
    ahead = dsl.Node("delay", (dsl.column("close"),), (("periods", -1),))
    assert not ahead.causal and not dsl.Node("negative", (ahead,)).causal and dsl.parse("delay(close, periods=1)").causal
    with pytest.raises(ValueError, match="look ahead"):
        dsl.evaluate(frame(spark, [1.0]), {"x": ahead})


def test_registered_operator(spark):
    from pyspark.sql import functions as F

    dsl.register_operator("twice_for_test", 1)(lambda a: a * 2)
    assert values(dsl.evaluate(frame(spark, [1.5]), {"x": "twice_for_test(close)"})) == [3.0]
    with pytest.raises(ValueError, match="exists"):
        dsl.register_operator("twice_for_test", 1)(F.abs)
