"""Commands end to end on a small synced store."""

import datetime as dt
import io
import json
import zipfile

import pytest

from barsmith import cli
from barsmith.functions import factors
from barsmith.plans import store as planned
from barsmith.sources import readers, writers
from barsmith.sources.base import open_source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark):
    return planned.landed_tree(spark, SF)


def test_sync_check_and_research(spark, landed, tmp_path, capsys):
    root = f"file://{tmp_path}/store"
    assert cli.main(["sync", "--root", root, "--landed", landed, "--mode", "rebuild"], spark) == 0
    assert '"status": "synced"' in capsys.readouterr().out
    assert cli.main(["check", "--root", root, "--report", f"file://{tmp_path}/audit"], spark) == 1
    summary = json.loads((tmp_path / "audit/summary.json").read_text())
    assert summary["status"] == "failed" and summary["issue_codes"]["DAILY_MISSING_SPAN"] > 0 and (tmp_path / "audit/summary.md").exists()
    common = ["--source", "qmt_daily", "--option", f"root={root}", "--option", f"landed={landed}", "--start", "2024-01-01", "--end", "2024-01-31"]
    assert cli.main(["factor", *common], spark) == 0 and "return_1d" in capsys.readouterr().out
    args = ["experiment", *common, "--holdout", "2024-01-20", "--report", f"file://{tmp_path}/run", "--factors", "return_1d", "--expression",
        "cs_rank(close)", "--model", "logistic_regression", "--task", "regression", "--mode", "single", "--top", "3"]
    assert cli.main(args, spark) == 0
    text = (tmp_path / "run/report.md").read_text()
    assert "## Drawdown episodes" in text and "## Repeat" in text and (tmp_path / "run/equity.svg").exists()


def test_search_command(spark, landed, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    cli.main(["sync", "--root", root, "--landed", landed], spark)
    monkeypatch.setattr(cli, "DEMO_STAGES", [cli.search.Stage((None, ("cs_rank", {})))])
    args = ["search", "--source", "qmt_daily", "--option", f"root={root}", "--option", f"landed={landed}", "--start", "2024-01-01", "--end",
        "2024-01-31", "--holdout", "2024-01-20", "--report", f"file://{tmp_path}/search", "--holdout-top-k", "1"]
    assert cli.main(args, spark) == 0
    assert "## Leaderboard" in (tmp_path / "search/report.md").read_text()


def test_minute_source(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, d, 9, m), 10.0 + d + m / 10, 100) for d in (2, 3, 4) for m in (31, 36, 41, 46)]
    bars = spark.createDataFrame([(c, t, p, p, p, p, v) for c, t, p, v in rows],
        "code string, trade_time timestamp, open double, high double, low double, close double, volume long")
    writers.write_bars(bars, f"{tmp_path}/bars")
    source = open_source(spark, "market_service", path=f"file://{tmp_path}/bars")
    assert source.list_symbols(5) == ["A"] and source.metadata()["rows"] == 12
    lines = source.kline("a", dt.datetime(2024, 1, 3, 9, 36), dt.datetime(2024, 1, 3, 9, 41), "15m").collect()
    assert [(r.bucket.minute, r.pre_close, r.close) for r in lines] == [(30, 16.6, 17.1)]
    assert source.snapshot(dt.datetime(2024, 1, 3, 9, 36)).count() == 1 and source.raw([], 5, 10).count() == 2
    built = source.build_features(source.load_bars(None, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5)), ["return_1d", "positive_bar_ratio"],
        {"x": "return_1d * 2"})
    assert built.columns[-3:] == ["positive_bar_ratio", "return_1d", "x"] and built.count() == 3
    with pytest.raises(ValueError, match="after end"):
        source.kline("a", "2024-01-03", "2024-01-02")


def test_factors_by_name_and_cache(spark, tmp_path):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(k), 10.0, 11.0, 9.0, 10.0 + k, 5.0) for k in range(8)]
    daily = spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double")
    out = factors.build(daily, ["return_1d"], None, {"x": "ts_sum(return_1d, window=2)"}).orderBy("trade_date").collect()
    assert out[2].x == pytest.approx(out[1].return_1d + out[2].return_1d)
    factors.register_factor("loop_a_for_test", "loop_b_for_test + 1")
    factors.register_factor("loop_b_for_test", "loop_a_for_test + 1", None)
    try:
        with pytest.raises(ValueError, match="circle"):
            factors.build(daily, [], None, {"x": "loop_a_for_test"})
        assert factors.homogeneity("loop_b_for_test") is None and factors.homogeneity("alpha_001") is None and factors.homogeneity("return_1d") == 0
    finally:
        del factors.FACTORS["loop_a_for_test"], factors.FACTORS["loop_b_for_test"], factors.PRICE_HOMOGENEITY["loop_b_for_test"]
    for bad in ({"names": ["nothing"]}, {"names": ["realized_vol"]}, {"names": [], "expressions": {"x": "realized_vol"}},
        {"names": [], "expressions": {"x": "nothing"}}, {"names": [], "expressions": {"close": "open"}}):
        with pytest.raises(ValueError):
            factors.build(daily, **bad)
    with pytest.warns(UserWarning, match="left out"):
        assert "realized_vol" not in factors.select_factors(None, False)
    cache = factors.FactorCache(f"file://{tmp_path}/cache")
    first = cache.build(daily, {"x": "delta(close, periods=1)"}, "n")
    again = cache.build(daily, {"x": "delta(close, periods=1)"}, "n")
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str) and len(list((tmp_path / "cache/n").iterdir())) == 1
    cache.build(daily.limit(5), {"x": "delta(close, periods=1)"}, "n")
    assert len(list((tmp_path / "cache/n").iterdir())) == 2


def test_price_scale_leaves_homogeneous_factors(spark):
    """Prices of a code times a constant change no factor of degree 0."""
    import random

    rng = random.Random(20260816)
    rows = []
    for i, code in enumerate("ABCDE"):
        price = 8.0 + 7 * i
        for k in range(40):
            price *= 1 + rng.gauss(0, 0.02)
            rows.append((code, dt.date(2024, 1, 1) + dt.timedelta(k), price * (1 + rng.gauss(0, 0.003)), price * 1.01, price * 0.99, price,
                1000.0 + rng.randint(0, 500)))
    schema = "code string, trade_date date, open double, high double, low double, close double, volume double"
    scale = {"A": 1.0, "B": 1.6, "C": 2.4, "D": 0.5, "E": 4.5}
    scaled = [(c, d, *[p * scale[c] for p in (o, h, w, e)], v) for c, d, o, h, w, e, v in rows]
    names = [n for n in factors.DAILY if factors.homogeneity(n) == 0]
    a, b = (factors.build(spark.createDataFrame(x, schema), names).orderBy("code", "trade_date").collect() for x in (rows, scaled))
    for x, y in zip(a, b, strict=True):
        for n in names:
            assert (x[n] is None) == (y[n] is None) and (x[n] is None or x[n] == pytest.approx(y[n], rel=1e-9, abs=1e-12)), n


def test_zipped_csv(spark, tmp_path):
    for year in (2023, 2024):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(f"{year}/a.csv", "code,close\nA,1\nB,2\n")
            z.writestr("readme.txt", "no")
        (tmp_path / f"{year}.zip").write_bytes(buffer.getvalue())
    got = readers.read_zipped_csv(spark, f"{tmp_path}/*.zip", ["code", "close", "volume"]).collect()
    assert sorted((r.archive, r.member, r.code, r.close, r.volume) for r in got)[0] == ("2023.zip", "2023/a.csv", "A", "1", None) and len(got) == 4
