"""The daily store: month shards and catalog tables kept in step with landing partitions, a month at a time.

Rows are read, filtered, corrected and written in one Spark job over all touched months; the driver handles
listings, fingerprints and the lock. Catalog tables of a run are written beside the old ones and published
by one small pointer file, so readers see all of a run or nothing.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_number
from ..sources import files
from ..sources import landing as source
from . import ingest
from .landing import ACTION_TERMS, lifecycle_frame

MODES = ("auto", "full", "rebuild")
KLINE = ["code", "trade_date", "open", "high", "low", "close", "pre_close", "volume", "amount", "suspend_flag"]
#: Dataset, partition key.
DATASETS = {"kline_1d": "date", "corporate_actions": "ex_date", "instrument_info": "snapshot", "trading_calendar": "snapshot"}
STATE = "dataset string, name string, bytes long, modified long, marker_modified long, sha256 string"
RUNS = "run_id string, mode string, status string, scanned long, dirty long, removed long, months long, rows_after long, started_at string"
c = F.col


class Locked(RuntimeError):
    pass


@dataclass(frozen=True)
class Delta:
    """What changed at the source: partitions with new content, with new times only, gone, and not yet complete (with the reason)."""

    dirty: tuple[source.Partition, ...] = ()
    refreshed: tuple[source.Partition, ...] = ()
    removed: tuple[tuple[str, str], ...] = ()
    pending: tuple[tuple[str, str, str], ...] = ()
    scanned: int = 0
    short_circuited: bool = False

    def empty(self) -> bool:
        return not (self.dirty or self.refreshed or self.removed)

    def months(self) -> list[tuple[int, int]]:
        """(year, month) of bars to write anew."""
        names = [p.name for p in self.dirty if p.dataset == "kline_1d"] + [n for d, n in self.removed if d == "kline_1d"]
        values = [n.split("=", 1)[-1] for n in names]
        return sorted({(int(v[:4]), int(v[4:6])) for v in values if len(v) == 8 and v.isdigit()})

    def datasets(self) -> set[str]:
        return {p.dataset for p in self.dirty} | {d for d, _ in self.removed}


@dataclass(frozen=True)
class Report:
    status: str
    run_id: str = ""
    scanned: int = 0
    dirty: int = 0
    removed: int = 0
    months: tuple[tuple[int, int], ...] = ()
    rows_after: int = -1
    pending: tuple[tuple[str, str, str], ...] = ()
    filtered: dict[str, int] = field(default_factory=dict)
    message: str = ""


class DailyStore:
    """A store at `root` fed from landing partitions below `landed`."""

    def __init__(self, spark: SparkSession, root: str, landed: str, errata: DataFrame | None = None):
        self.spark, self.root, self.landed, self.errata = spark, root.rstrip("/"), landed.rstrip("/"), errata

    # ---- catalog

    def _current(self) -> dict:
        path = f"{self.root}/catalog/CURRENT.json"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else {"tables": {}, "metadata": {}}

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        path = self._current()["tables"].get(name)
        if path is None:
            if schema is None:
                raise ValueError(f"the store has no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{path}")

    def metadata(self) -> dict:
        return self._current()["metadata"]

    def months(self) -> list[tuple[int, int]]:
        found = files.listed(self.spark, f"{self.root}/bars_1d/year=*/month=*")
        return sorted((int(e.path.rsplit("/", 2)[-2].split("=")[1]), int(e.name.split("=")[1])) for e in found)

    def bars(self, start=None, end=None, codes: list[str] | None = None, suspended: bool = False) -> DataFrame:
        """Bars of a closed range of dates; suspended days only on request. The range prunes months."""
        if not self.months():
            raise ValueError("the store has no bars")
        out = self.spark.read.parquet(f"{self.root}/bars_1d")
        month = c("year") * 12 + c("month")
        for at, keep in ((start, lambda m: month >= m), (end, lambda m: month <= m)):
            if at is not None:
                day = dt.date.fromisoformat(str(at)[:10])
                out = out.filter(keep(day.year * 12 + day.month))
        if start is not None:
            out = out.filter(c("trade_date") >= F.lit(start).cast("date"))
        if end is not None:
            out = out.filter(c("trade_date") <= F.lit(end).cast("date"))
        if codes is not None:
            out = out.filter(c("code").isin([x.strip().upper() for x in codes]))
        return out if suspended else out.filter("coalesce(suspend_flag, 0) = 0")

    # ---- changes

    def _watermark(self) -> dict[str, str]:
        folders = "\n".join(f"{e.name}:{e.modified}" for d in DATASETS for e in files.listed(self.spark, f"{self.landed}/{d}"))
        return {"watermark_date": source.last_complete(self.spark, self.landed), "watermark_folders": hashlib.sha256(folders.encode()).hexdigest()}

    def detect(self, mode: str = "auto", verify: bool = False) -> Delta:
        """Compare listings with the last run's fingerprints: times and sizes first, then markers' digests, on request the files' own."""
        known = {(r.dataset, r.name): r for r in self.table("ingest_state", STATE).collect()}  # one per partition
        meta = self.metadata()
        if mode == "auto" and known and meta.get("watermark_date") and all(meta.get(k) == v for k, v in self._watermark().items()):
            return Delta(short_circuited=True)
        dirty, refreshed, removed, pending, scanned = [], [], [], [], 0
        for dataset, key in DATASETS.items():
            found = source.partitions(self.spark, self.landed, dataset, key)
            scanned += len(found)
            removed += [(dataset, n) for d, n in known if d == dataset and n not in {p.name for p in found}]
            wrong = set()
            if verify and found:
                v = source.verified(self.spark, self.landed, dataset, key, ".+", True)
                wrong = {r.partition for r in v.filter("problem = 'AUXILIARY_HASH_MISMATCH'").collect()}
            for p in found:
                old = known.get((dataset, p.name))
                if p.bytes is None or p.marker_modified is None:
                    pending.append((dataset, p.name, "no data" if p.bytes is None else "no marker"))
                elif mode != "rebuild" and old and (old.bytes, old.modified, old.marker_modified) == (p.bytes, p.modified, p.marker_modified):
                    continue
                elif (m := source.marker(self.spark, p)) is None:
                    pending.append((dataset, p.name, "marker without a digest"))
                elif p.name in wrong:
                    pending.append((dataset, p.name, "digest differs"))
                elif mode != "rebuild" and old and old.sha256 == m["sha256"]:
                    refreshed.append(p)
                else:
                    dirty.append(p)
        return Delta(tuple(dirty), tuple(refreshed), tuple(removed), tuple(pending), scanned)

    # ---- rows

    def lifecycle(self) -> DataFrame:
        found = [p for p in source.partitions(self.spark, self.landed, "instrument_info", "snapshot") if p.value == "latest" and p.bytes]
        if not found:
            raise ValueError("no instrument snapshot has landed")
        columns = ["code", "instrument_name", "open_date", "expire_date", "is_trading", "instrument_status"]
        return lifecycle_frame(source.read(self.spark, self.landed, "instrument_info", columns, found).withColumn("seq", F.monotonically_increasing_id()))

    def classified(self, months: list[tuple[int, int]]) -> DataFrame:
        """Landed rows of those months with the reason why each is kept or not."""
        prefixes = tuple(f"{y:04d}{m:02d}" for y, m in months)
        found = [p for p in source.partitions(self.spark, self.landed, "kline_1d", "date") if p.value.startswith(prefixes) and p.bytes] if prefixes else []
        rows = source.read(self.spark, self.landed, "kline_1d", KLINE, found).withColumn("code", F.upper(F.trim("code"))).withColumn("trade_date",
            F.trim("trade_date"))
        return ingest.classify(rows, self.lifecycle())

    @staticmethod
    def store_rows(classified: DataFrame, errata: DataFrame | None = None) -> DataFrame:
        """Kept rows with the store's types, errata applied, volume rounded."""
        numbers = KLINE[2:]
        kept = classified.filter("reason = 'kept'").select("code", c("parsed_date").alias("trade_date"), *[finite_number(c(n)).alias(n) for n in numbers])
        if errata is not None:
            kept = ingest.override(kept, errata, tuple(numbers))
        return kept.withColumn("volume", F.round("volume").cast("long")).withColumn("suspend_flag", c("suspend_flag").cast("tinyint"))

    def rewrite(self, months: list[tuple[int, int]]) -> dict[str, int]:
        """Write those months' shards anew and drop those left without rows; rows per reason."""
        classified = self.classified(months)
        rows = self.store_rows(classified, self.errata).withColumn("year", F.year("trade_date")).withColumn("month", F.month("trade_date"))
        rows = rows.repartition("year", "month").sortWithinPartitions("year", "month", "code", "trade_date")
        (
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year",
            "month").parquet(f"{self.root}/bars_1d")
        )
        written = {(r.year, r.month) for r in rows.select("year", "month").distinct().collect()}  # one per month
        for y, m in set(months) - written:
            files.delete(self.spark, f"{self.root}/bars_1d/year={y}/month={m}")
        return {r.reason: r.n for r in ingest.reason_counts(classified).collect()}

    def _calendar(self, old: DataFrame) -> DataFrame:
        new = source.read(self.spark, self.landed, "trading_calendar", ["trade_date", "calendar_symbol"])
        new = ingest.accumulate_calendar(new.withColumn("seq", F.lit(0)))
        return ingest.upsert(old, new, ["trade_date"])

    def _actions(self, old: DataFrame, delta: Delta, whole: bool) -> DataFrame:
        """The store's actions: all anew, or the touched ex dates replaced."""
        parts = source.partitions(self.spark, self.landed, "corporate_actions", "ex_date")
        gone = {n.split("=", 1)[-1] for d, n in delta.removed if d == "corporate_actions"}
        changed = {p.value for p in delta.dirty if p.dataset == "corporate_actions"}
        if not whole and len(gone | changed) > 200:
            whole = True
        mine = [p for p in parts if p.bytes and (whole or p.value in changed)]
        raw = source.read(self.spark, self.landed, "corporate_actions", ["code", "ex_date", *ACTION_TERMS], mine)
        new = raw.select(F.upper(F.trim("code")).alias("code"), F.try_to_date(F.trim("ex_date"), "yyyyMMdd").alias("ex_date"),
            *[finite_number(c(t)).alias(t) for t in ACTION_TERMS]).filter("ex_date IS NOT NULL")
        if whole:
            return new
        return old.filter(~F.date_format("ex_date", "yyyyMMdd").isin(sorted(gone | changed))).unionByName(new)

    # ---- runs

    def _locked(self, timeout: float, stale: float):
        path, me = f"{self.root}/.sync.lock", uuid.uuid4().hex
        until = time.time() + timeout
        while not files.write_text(self.spark, path, me, new=True):
            held = files.listed(self.spark, path)
            if held and time.time() - held[0].modified / 1000 > stale:
                files.delete(self.spark, path)
            elif time.time() >= until:
                raise Locked(f"{path} is held")
            else:
                time.sleep(min(0.2, max(timeout, 0.01)))
        return path

    def sync(self, mode: str = "auto", verify: bool = False, dry_run: bool = False, lock_timeout: float = 3600.0, stale_lock: float = 6 * 3600.0) -> Report:
        """Bring the store up to date; status synced, up_to_date, dry_run or skipped_locked."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        try:
            lock = self._locked(lock_timeout, stale_lock)
        except Locked as e:
            return Report("skipped_locked", message=str(e))
        try:
            return self._run(mode, verify, dry_run)
        finally:
            files.delete(self.spark, lock)

    def _run(self, mode: str, verify: bool, dry_run: bool) -> Report:
        started = dt.datetime.now(dt.timezone.utc)
        delta = self.detect(mode, verify)
        months = delta.months()
        if mode == "rebuild":  # shards whose source is gone
            landed = {(int(p.value[:4]), int(p.value[4:6])) for p in source.partitions(self.spark, self.landed, "kline_1d", "date")
                if len(p.value) == 8 and p.value.isdigit()}
            months = sorted(set(months) | (set(self.months()) - landed))
        if delta.empty() and not months:
            return Report("up_to_date", scanned=delta.scanned, pending=delta.pending, message="short circuit" if delta.short_circuited else "no change")
        if dry_run:
            return Report("dry_run", "", delta.scanned, len(delta.dirty), len(delta.removed), tuple(months), pending=delta.pending)
        run = f"sync_{started:%Y%m%d_%H%M%S_%f}"
        current = self._current()
        filtered = self.rewrite(months) if months else {}
        whole = mode == "rebuild"
        tables = dict(current["tables"])

        def publish(name: str, df: DataFrame) -> None:
            path = f"catalog/{run}/{name}"
            df.write.mode("overwrite").parquet(f"{self.root}/{path}")
            tables[name] = path

        publish("instruments", self.lifecycle())
        touched = delta.datasets()
        if whole or "trading_calendar" in touched:
            publish("trading_calendar", self._calendar(self.table("trading_calendar", "trade_date date, calendar_symbol string")))
        terms = ", ".join(f"{t} double" for t in ACTION_TERMS)
        if whole or "corporate_actions" in touched:
            publish("corporate_actions", self._actions(self.table("corporate_actions", f"code string, ex_date date, {terms}"), delta, whole))
        now = [(p.dataset, p.name, p.bytes, p.modified, p.marker_modified, source.marker(self.spark, p)["sha256"]) for p in (*delta.dirty, *delta.refreshed)]
        gone = self.spark.createDataFrame(list(delta.removed), "dataset string, name string")
        publish("ingest_state", ingest.upsert(self.table("ingest_state", STATE), self.spark.createDataFrame(now, STATE), ["dataset", "name"], gone))
        rows_after, anchor = 0, ""
        if self.months():
            bars = self.spark.read.parquet(f"{self.root}/bars_1d")
            inventory = bars.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("code").alias("symbols"),
                F.countDistinct("trade_date").alias("trading_days"), F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"))
            publish("monthly_inventory", inventory)
            flagged = F.sum(F.when(F.coalesce("suspend_flag", F.lit(0)) == 1, 1).otherwise(0))
            publish("symbols", bars.groupBy("code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
                F.count(F.lit(1)).alias("bar_count"), flagged.alias("suspended_days")))
            tables_now = self.spark.read.parquet(f"{self.root}/{tables['monthly_inventory']}").agg(F.sum("rows"), F.max("max_date")).first()
            rows_after, anchor = int(tables_now[0]), str(tables_now[1])
        else:
            for name in ("monthly_inventory", "symbols"):
                tables.pop(name, None)
        runs = self.spark.createDataFrame(
            [(run, mode, "synced", delta.scanned, len(delta.dirty), len(delta.removed), len(months), rows_after, started.isoformat())], RUNS)
        publish("sync_runs", self.table("sync_runs", RUNS).unionByName(runs))
        meta = current["metadata"] | self._watermark() | {"last_run": run, "source": self.landed, "adjust_anchor_date": anchor,
            "lifecycle_filter": "instruments", "adjust_policy": "raw"}
        files.write_text(self.spark, f"{self.root}/catalog/CURRENT.json", json.dumps({"tables": tables, "metadata": meta}, sort_keys=True))
        return Report("synced", run, delta.scanned, len(delta.dirty), len(delta.removed), tuple(months), rows_after, delta.pending, filtered,
            f"{len(months)} months, {rows_after} rows")


def filter_summary(filtered: dict[str, int]) -> list[str]:
    """Lines of a report: every reason in the order of testing, zero or not, others after them."""
    known = [r for r in ingest.REASONS if r != "kept"]
    return [f"{r}: {filtered.get(r, 0)} rows" for r in known] + [f"{r}: {n} rows" for r, n in sorted(filtered.items()) if r not in ingest.REASONS]
