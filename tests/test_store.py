"""Landing partitions and the synced store, end to end on small trees."""

import datetime as dt
import json
import time

import pytest

from barsmith.operators.store import Delta, DailyStore, Locked, filter_summary
from barsmith.sources import base, files, landing, readers
from barsmith.streaming.kline import run_available, stream_kline

KLINE = ["code", "trade_date", "open", "high", "low", "close", "pre_close", "volume", "amount", "suspend_flag"]


def kline(spark, rows):
    """rows: (date, code, close, volume, flag)."""
    data = [(d, c, d, str(p), str(p), str(p), str(p), str(p), str(v), str(p * v), str(f)) for d, c, p, v, f in rows]
    return spark.createDataFrame(data, "date string, " + ", ".join(f"{n} string" for n in KLINE))


BARS = [("20240102", "600000.sh", 10.0, 100.4, 0), ("20240102", "000001.SZ", 20.0, 50.6, 0), ("20240103", "600000.SH", 10.5, 0, 1),
    ("20240103", "000001.SZ", 21.0, 60, 0), ("20240201", "000001.SZ", 22.0, 70, 0), ("20240201", "999999.XX", 1.0, 1, 0)]
LIVES = [("latest", "600000.SH", "pf", "20240103", "99999999", "1", ""), ("latest", "000001.SZ", "pa", "19910403", "19700427", "1", "")]


def land(spark, root, rows=BARS, **k):
    return landing.write(kline(spark, rows), root, "kline_1d", "date", ["code"], **k)


@pytest.fixture
def tree(spark, tmp_path):
    root = f"file://{tmp_path}/landed"
    land(spark, root)
    lives = spark.createDataFrame(LIVES, "snapshot string, code string, instrument_name string, open_date string, expire_date string, "
        "is_trading string, instrument_status string")
    landing.write(lives, root, "instrument_info", "snapshot", ["code"])
    days = spark.createDataFrame([("latest", d, "SH") for d in ("20240102", "20240103", "20240201")],
        "snapshot string, trade_date string, calendar_symbol string")
    landing.write(days, root, "trading_calendar", "snapshot", ["trade_date"])
    terms = ("ex_date string, code string, cash_dividend_per_share string, bonus_share_per_share string, capitalization_per_share string, "
        "rights_issue_per_share string, rights_issue_price string, share_reform_flag string, adjustment_factor string")
    landing.write(spark.createDataFrame([("20240103", "000001.SZ", "0", "0", "0", "0", "0", "0", "1.5")], terms), root, "corporate_actions",
        "ex_date", ["code"])
    return DailyStore(spark, f"file://{tmp_path}/store", root)


def content(store):
    return sorted((r.code, r.trade_date.isoformat(), r.close, r.volume) for r in store.bars(suspended=True).collect())


KEPT = [("000001.SZ", "2024-01-02", 20.0, 51), ("000001.SZ", "2024-01-03", 21.0, 60), ("000001.SZ", "2024-02-01", 22.0, 70),
    ("600000.SH", "2024-01-03", 10.5, 0)]


def test_sync_from_nothing_then_nothing_to_do(tree):
    report = tree.sync()
    assert (report.status, report.months, report.rows_after) == ("synced", ((2024, 1), (2024, 2)), 4)
    assert report.filtered["before_listing_with_data"] == 1 and report.filtered["unknown_code"] == 1 and report.filtered[
        "kept"] == 4 and report.filtered["after_delisting"] == 0
    assert content(tree) == KEPT and [r.code for r in tree.bars(codes=["600000.sh"]).collect()] == []
    assert tree.sync().status == "up_to_date"
    assert tree.metadata()["adjust_anchor_date"] == "2024-02-01" and tree.table("sync_runs").count() == 1
    assert [(r.code, r.bar_count, r.suspended_days) for r in tree.table("symbols").orderBy("code").collect()] == [("000001.SZ", 3, 0), ("600000.SH", 1, 1)]
    assert filter_summary(report.filtered)[3] == "unknown_code: 1 rows"


def test_changes_removals_and_rebuild(spark, tree):
    tree.sync()
    land(spark, tree.landed, [("20240103", "000001.SZ", 99.0, 5, 0)], overwrite=True)
    files.delete(spark, f"{tree.landed}/kline_1d/date=20240201")
    plan = tree.sync(dry_run=True)
    assert plan.status == "dry_run" and plan.months == ((2024, 1), (2024, 2)) and content(tree) == KEPT
    report = tree.sync()
    assert (report.dirty, report.removed, report.rows_after) == (1, 1, 2) and tree.months() == [(2024, 1)]
    assert content(tree) == [("000001.SZ", "2024-01-02", 20.0, 51), ("000001.SZ", "2024-01-03", 99.0, 5)]
    assert tree.sync("rebuild").rows_after == 2 and tree.sync().status == "up_to_date"


def test_touched_but_equal_is_refreshed_and_incomplete_is_pending(spark, tree):
    tree.sync()
    time.sleep(1.1)
    land(spark, tree.landed, BARS[:2], overwrite=True)
    files.delete(spark, f"{tree.landed}/kline_1d/date=20240201/_SUCCESS.json")
    delta = tree.detect()
    assert not delta.dirty and [p.name for p in delta.refreshed] == ["date=20240102"] and delta.pending == (("kline_1d", "date=20240201", "no marker"),)
    assert delta.months() == [] and not delta.empty() and Delta().empty()


def test_verification_by_digest(spark, tree):
    tree.sync()
    data = files.listed(spark, f"{tree.landed}/kline_1d/date=20240102/*.csv")[0]
    time.sleep(1.1)
    files.write_text(spark, data.path, files.read_text(spark, data.path) + "x\n")
    assert ("kline_1d", "date=20240102", "digest differs") in tree.detect("full", verify=True).pending


def test_a_held_lock_skips_and_a_stale_one_is_broken(spark, tree):
    lock = f"{tree.root}/.sync.lock"
    files.write_text(spark, lock, "other")
    assert tree.sync(lock_timeout=0.0).status == "skipped_locked"
    with pytest.raises(Locked):
        tree._locked(0.0, 1000)
    assert tree.sync(lock_timeout=0.0, stale_lock=-1.0).status == "synced" and not files.exists(spark, lock)
    with pytest.raises(ValueError, match="mode"):
        tree.sync("sometimes")


def test_landing_scopes_keys_and_watermark(spark, tmp_path):
    root = f"file://{tmp_path}/landed"
    assert land(spark, root, scope={"symbols": ["A"]}) == {"20240102": "written", "20240103": "written", "20240201": "written"}
    assert set(land(spark, root, scope={"symbols": ["A"]}).values()) == {"skipped"}
    with pytest.raises(ValueError, match="another scope"):
        land(spark, root, scope={"symbols": ["B"]})
    with pytest.raises(ValueError, match="repeated"):
        land(spark, root, [BARS[0], BARS[0]])
    assert landing.verified(spark, root, "kline_1d", "date").filter("problem IS NOT NULL").count() == 0
    found = json.loads(files.read_text(spark, f"{root}/kline_1d/date=20240102/_SUCCESS.json"))
    assert found["rows"] == 2 and found["partition_scope"] == {"symbols": ["A"]} and len(found["sha256"]) == len(found["identity_sha256"]) == 64
    assert landing.complete_run(spark, root, "20240102", {"kline_1d": "date"}) and landing.last_complete(spark, root) == "20240102"
    assert not landing.complete_run(spark, root, "20240104", {"kline_1d": "date"})
    assert landing.partition_issues(spark, root, "nothing", "date").first().issue_code == "KLINE_DATASET_MISSING"
    files.write_text(spark, f"{root}/kline_1d/date=2024-01-02/x.csv", "a\n1\n")
    assert landing.duplicate_dates(spark, root, "kline_1d", "date") == ["20240102"]


def test_staged_batches(spark, tmp_path):
    root = f"file://{tmp_path}/staging/job"
    write = lambda name, text: files.write_text(spark, f"{root}/{name}", text)
    import hashlib

    good = "code,close\nA,1\n"
    meta = json.dumps({"rows": 1, "sha256": hashlib.sha256(good.encode()).hexdigest()})
    for name, text in {"batch_0.csv": good, "batch_0.meta.json": meta, "batch_1.csv": good, "batch_2.csv": good, "batch_2.meta.json": "[",
        "batch_3.csv": good, "batch_3.meta.json": json.dumps({"rows": 7}), "batch_4.csv": good,
        "batch_4.meta.json": json.dumps({"rows": 1, "sha256": "x"})}.items():
        write(f"kline_daily_20240102/{name}", text)
    write("kline_daily_20240103/note.txt", "")
    write("kline_daily_2024/batch_0.csv", good)
    write("kline_1d/batch_9.csv", good)
    got = sorted((r.issue_code, r.source_file.rsplit("/", 1)[-1]) for r in landing.staging_issues(spark, root).collect())
    assert [c for c, _ in got] == [
        "INVALID_PARTITION_DATE", "STAGING_BATCHES_MISSING", "STAGING_BATCH_HASH_MISMATCH", "STAGING_BATCH_HASH_MISSING",
        "STAGING_BATCH_METADATA_INVALID", "STAGING_BATCH_METADATA_MISSING", "STAGING_BATCH_ROW_COUNT_MISMATCH", "STAGING_DAILY_BATCH_GAPS",
    ]
    top = f"file://{tmp_path}"
    assert landing.staging_job(spark, top).endswith("/staging/job")
    files.write_text(spark, f"{top}/staging/other/kline_daily_20240102/batch_0.csv", good)
    with pytest.raises(ValueError, match="AMBIGUOUS"):
        landing.staging_job(spark, top)


def test_daily_source(spark, tree):
    tree.sync()
    source = base.open_source(spark, "qmt_daily", root=tree.root, landed=tree.landed)
    assert source.list_symbols(10) == ["000001.SZ", "600000.SH"] and source.metadata()["last_date"] == dt.date(2024, 2, 1)
    assert [r.close for r in source.load_bars(["000001.SZ"], "2024-01-02", "2024-02-01").orderBy("trade_date").collect()] == [20.0, 31.5, 33.0]
    anchored = base.open_source(spark, "qmt_daily", root=tree.root, landed=tree.landed, adjust="qfq")
    assert [round(r.close, 9) for r in anchored.load_bars(["000001.SZ"], "2024-01-02", "2024-02-01").orderBy("trade_date").collect()] == [
        round(20 / 1.5, 9), 21.0, 22.0]
    assert anchored.cache_namespace() == "qmt_daily/qfq/2024-02-01/no_suspended/raw_volume" and source.cache_namespace() != anchored.cache_namespace()
    assert source.calendar("2024-01-01", "2024-01-31").count() == 2 and source.actions(end="2024-01-02").count() == 0
    with pytest.raises(ValueError, match="minute bars"):
        source.build_features(source.load_bars(None, "2024-01-02", "2024-02-01"), ["realized_vol"])


def test_source_registry():
    assert base.available_sources() == ["market_service", "qmt_daily"] and "adjust" in base.source_options("qmt_daily")
    with pytest.raises(ValueError, match="no source"):
        base.open_source(None, "nowhere")
    with pytest.raises(ValueError, match="no options"):
        base.open_source(None, "market_service", adjust="hfq")
    with pytest.raises(ValueError, match="exists"):
        base.register_source(base.DailySource)
    with pytest.raises(TypeError):
        base.register_source(dict)


def test_stream_keeps_files_and_drops_late_rows(spark, tmp_path):
    schema = "code string, trade_time timestamp, seq long, open double, high double, low double, close double, volume long"
    row = lambda d, h, p: ("A", dt.datetime(2024, 1, d, h, 1), 1, p, p, p, p, 10)
    batches = [[row(10, 9, 1.0)], [row(10, 9, 2.0), row(11, 9, 5.0), row(9, 23, 7.0)], [row(1, 9, 3.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if k < 2 else 0)
    bars = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run_available(spark, stream_kline(bars, "60m", "1 day"), f"file://{tmp_path}/out")
    lines = {r.bucket.day: (r.high, r.volume) for r in got.collect()}
    assert lines == {10: (2.0, 20), 11: (5.0, 10), 9: (7.0, 10)}


def test_minute_rows(spark):
    raw = spark.createDataFrame([(" a ", "2024-01-02 09:35", "1", "2", "0.5", "1.5", "10.5", "x"), ("b", "20240102", "1", "1", "1", "1", "1", "1"),
        ("", "2024-01-02 09:35:00", "1", "1", "1", "1", "1", "1")],
        "code string, trade_time string, open string, high string, low string, close string, volume string, amount string")
    got = readers.normalised_bars(raw).collect()
    assert len(got) == 1 and (got[0].code, got[0].trade_time, got[0].volume, got[0].amount) == ("A", dt.datetime(2024, 1, 2, 9, 35), 11, None)
