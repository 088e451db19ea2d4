"""Charts, documents, settings and progress: no Spark needed but for writing."""

import datetime as dt
import io
import logging

import pytest

from barsmith.operators import landing
from barsmith.progress import Progress, Timings, elapsed_text, log_elapsed
from barsmith.reporting import charts, documents
from barsmith.settings import RunSettings, without_comments

DAYS = [dt.date(2024, 1, d) for d in (2, 3, 4)]


def test_ticks_cover_the_range():
    assert charts.ticks(0.0, 1.0) == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    for low, high in ((-0.013, 0.042), (5.0, 5.0), (1e-9, 3e-9), (900, 12000)):
        t = charts.ticks(low, high)
        assert t[0] <= low and t[-1] >= high and 3 <= len(t) <= 9


def test_line_charts_check_their_input():
    svg = charts.line_chart("A & B", DAYS, {"x": [1.0, None, 2.0], "y": [1.0, 1.5, 2.0]}, marks={DAYS[1]: "holdout"})
    assert svg.startswith("<svg") and svg.count("<polyline") == 1 and svg.count("<circle") == 2 and "A &amp; B" in svg and "holdout" in svg
    for days, series in ((DAYS[::-1], {"x": [1.0, 2.0, 3.0]}), (DAYS, {"x": [1.0]}), (DAYS, {"x": [1.0, float("nan"), 2.0]}), ([], {}),
        (DAYS, {"x": [None] * 3})):
        with pytest.raises(ValueError):
            charts.line_chart("t", days, series)


def test_drawdown_chart_refuses_another_curve():
    rows = [{"target_date": d, "top_equity": e, "top_drawdown": w} for d, e, w in zip(DAYS, (1.1, 0.99, 1.2), (0.0, -0.1, 0.0), strict=True)]
    assert "<polygon" in charts.drawdown_chart(rows)
    rows[1]["top_drawdown"] = -0.2
    with pytest.raises(ValueError, match="not that"):
        charts.drawdown_chart(rows)


def test_bars_and_other_charts():
    assert charts.bar_chart("b", {"a": 0.2, "c": -0.1}, percent=True).count("<rect") == 3
    rows = [{"target_date": d, "gross": 0.01, "rank_ic_20": None if k == 0 else 0.1, "rank_ic_60": None} for k, d in enumerate(DAYS)]
    assert "10 bp" in charts.slippage_chart(rows, [0.0, 0.001], {0.0: 1.0, 0.001: 0.998}) and "rank IC 20" in charts.rolling_ic_chart(rows, DAYS[1])
    assert "f1" in charts.objective_chart([{"factor_id": "f1", "selection_rank_ic": 0.1}])
    with pytest.raises(ValueError):
        charts.bar_chart("b", {})


def test_documents(spark, tmp_path):
    doc = documents.Document("Report <1>").add("Table one", rows=[{"a": 1.23456, "b": None, "c": "x|y"}]).add("Empty", rows=[]).add("Chart",
        chart=charts.bar_chart("b", {"a": 1.0}))
    text = doc.markdown()
    assert "| 1.2346 | - | x\\|y |" in text and "_No rows._" in text and "![Chart](chart.svg)" in text and "- [Table one](#table-one)" in text
    page = doc.html()
    assert "Report &lt;1&gt;" in page and "<svg" in page and page.count("<table>") == 1
    assert [p.rsplit("/", 1)[1] for p in doc.write(spark, f"file://{tmp_path}/r")] == ["report.md", "report.html",
        "chart.svg"] and (tmp_path / "r/report.md").read_text() == text
    assert documents.reproduction("m", {"codes": ["a b", "c"], "dry_run": True, "none": None, "n": 3}) == "python -m m --codes 'a b' c --dry-run --n 3"
    with pytest.raises(ValueError, match="more than"):
        documents.rows_of(spark.range(5), 4)


def test_settings():
    text = '{ "symbols": ["a.SZ"], // one\n "sector": "x//y", /* two\n lines */ "batch_size": 10, "start_date": "20240102", "note": "é \\" // kept" }'
    s = RunSettings.parse(text)
    assert s.sector == "x//y" and s.batch_size == 10 and s.extra == {"note": 'é " // kept'} and s.scope()["symbols"] == ["A.SZ"]
    for bad in ('{"symbols": ["a"], "mode": "x"}', '{"symbols": ["a"], "start_date": "2024"}', "{}", "[1]", "{",
        '{"symbols": ["a"], "datasets": ["y"]}', '{"symbols": ["a"], "lag_cutoff": "25:00"}', "{} /* "):
        with pytest.raises(ValueError):
            RunSettings.parse(bad)
    assert without_comments('{"a": "/* no */"} // yes') == '{"a": "/* no */"} '


def test_incremental_dates():
    at = dt.datetime(2024, 1, 10, 17, 0)
    s = RunSettings(symbols=("a.SZ",), mode="incremental")
    assert s.dates("20240105", at) == ("20240106", "20240110") and s.dates("20240105", at.replace(hour=9)) == ("20240106", "20240109")
    assert s.dates("20240110", at) is None and RunSettings(symbols=("a",), start_date="20240101", end_date="20240102").dates("", at) == ("20240101", "20240102")
    with pytest.raises(ValueError, match="nothing has landed"):
        s.dates("", at)


def test_progress_and_timings(caplog):
    now = [0.0]
    out = io.StringIO()
    p = Progress(4, "work", out, True, 0.0, lambda: now[0])
    now[0] = 10.0
    p.advance(1)
    assert "1/4" in out.getvalue() and "left 0:00:30" in p.text(90) and len(p.text(40)) <= 40
    p.advance(9)
    assert p.done == 4 and out.getvalue().endswith("\n")
    Progress(2, "quiet", io.StringIO(), False).advance()
    t = Timings()
    assert t.track("f")(lambda x: x + 1)(1) == 2 and t.seconds["f"] >= 0 and elapsed_text(3725) == "1:02:05"
    with caplog.at_level(logging.INFO):
        log_elapsed(logging.getLogger("t"), "part")(lambda: None)()
    assert "part:" in caplog.text


def test_jobs():
    assert list(landing.batches(list("abcde"), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert landing.job_key({"a": 1, "b": [2]}) == landing.job_key({"b": [2], "a": 1}) != landing.job_key({"a": 2, "b": [2]})
    with pytest.raises(ValueError):
        list(landing.batches([1], 0))
