"""Landing partitions: dataset/<partition>=<value>/ with CSV and a marker _SUCCESS.json of rows, digests and scope."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.issues import SCHEMA as ISSUE_SCHEMA
from . import files

MARKER = "_SUCCESS.json"
#: The columns of each dataset's files, in order; others follow them.
CONTRACTS = {
    "kline_1d": ["code", "trade_date", "open", "high", "low", "close", "pre_close", "volume", "amount", "suspend_flag"],
    "instrument_info": ["code", "instrument_name", "open_date", "expire_date", "is_trading", "instrument_status"],
    "trading_calendar": ["trade_date", "calendar_symbol"],
    "corporate_actions": [
        "code", "ex_date", "cash_dividend_per_share", "bonus_share_per_share", "capitalization_per_share", "rights_issue_per_share",
        "rights_issue_price", "share_reform_flag", "adjustment_factor",
    ],
}
c = F.col


@dataclass(frozen=True)
class Partition:
    """A partition folder as listed: its files' sizes and times, and the marker's (None: no such file)."""

    dataset: str
    name: str
    path: str
    bytes: int | None
    modified: int | None
    marker_modified: int | None

    @property
    def key(self) -> str:
        return self.name.split("=", 1)[0]

    @property
    def value(self) -> str:
        return self.name.split("=", 1)[-1]


def partitions(spark: SparkSession, root: str, dataset: str, key: str) -> list[Partition]:
    """Folders key=* of a dataset."""
    data = {}
    for e in files.listed(spark, f"{root}/{dataset}/{key}=*/*.csv"):
        folder = e.path.rsplit("/", 1)[0]
        n, t = data.get(folder, (0, 0))
        data[folder] = (n + e.bytes, max(t, e.modified))
    marks = {e.path.rsplit("/", 1)[0]: e.modified for e in files.listed(spark, f"{root}/{dataset}/{key}=*/{MARKER}")}
    return [Partition(dataset, e.name, e.path, *data.get(e.path, (None, None)), marks.get(e.path)) for e in files.listed(spark,
        f"{root}/{dataset}/{key}=*") if e.folder]


def marker(spark: SparkSession, p: Partition) -> dict | None:
    """The partition's marker; None if it is missing or no object with a digest."""
    if p.marker_modified is None:
        return None
    try:
        found = json.loads(files.read_text(spark, f"{p.path}/{MARKER}"))
    except ValueError:
        return None
    return found if isinstance(found, dict) and found.get("sha256") else None


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in columns])


def read(spark: SparkSession, root: str, dataset: str, columns: list[str], values: list[Partition] | None = None) -> DataFrame:
    """Rows of all, or of the given, partitions: the dataset's first columns as text, and source_file; ValueError if the first file has others."""
    found = files.listed(spark, f"{root}/{dataset}/*/*.csv" if values is None else f"{values[0].path}/*.csv" if values else f"{root}/{dataset}/none")
    if found:
        header = files.read_text(spark, found[0].path, 1 << 16).split("\n", 1)[0].lstrip("\ufeff").strip().split(",")
        if header[: len(columns)] != columns:
            raise ValueError(f"{found[0].path} has the columns {header}, not {columns}")
    reader = spark.read.option("header", "true").schema(text_schema(columns))
    if values is None:
        rows = reader.csv(f"{root}/{dataset}/*/*.csv")
    elif values:
        rows = reader.csv([f"{p.path}/*.csv" for p in values])
    else:
        return spark.createDataFrame([], text_schema([*columns, "source_file"]))
    return rows.withColumn("source_file", F.col("_metadata.file_path"))


def digests(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """partition (key=value), rows (lines but for the header), bytes and sha256 of the
    dataset's files; a partition of several files has the digest of their digests."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(f"{root}/{dataset}")
    text = c("content").cast("string")
    lines = F.size(F.split(F.regexp_replace(text, "\n+$", ""), "\n")) - 1
    one = raw.select(F.element_at(F.split("path", "/"), -2).alias("partition"), c("length").alias("bytes"), F.sha2("content", 256).alias("sha"),
        F.greatest(lines, F.lit(0)).alias("rows"), "path")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: x["sha"]), "")
    out = one.groupBy("partition").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"), joined.alias("all"))
    return out.select("partition", "rows", "bytes", F.when(c("files") == 1, c("all")).otherwise(F.sha2("all", 256)).alias("sha256"))


def identity(df: DataFrame, partition: str, keys: list[str]) -> DataFrame:
    """partition value and an order-free digest of its key columns."""
    row = F.xxhash64(*[F.coalesce(c(k).cast("string"), F.lit("\0")) for k in keys])
    return df.groupBy(c(partition).cast("string").alias("value")).agg(
        F.sha2(F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))), 256).alias("identity"))


def write(df: DataFrame, root: str, dataset: str, partition: str, keys: list[str], columns: list[str] | None = None, scope: dict | None = None,
    overwrite: bool = False) -> dict[str, str]:
    """Land df (rows with `partition`) and mark its partitions; {value: "written" or "skipped"}.

    A partition with a marker of the same scope is skipped unless overwrite; one of another scope is refused. A key may
    not repeat within a partition. Rows are sorted by key; columns beyond `columns` (by default the dataset's contract, those
    df lacks left empty) follow in alphabetical order.
    """
    spark = df.sparkSession
    columns = columns or CONTRACTS[dataset]
    df = df.withColumns({n: F.lit(None).cast("string") for n in columns if n not in df.columns})
    if df.groupBy(partition, *keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"repeated {keys} in {dataset}")
    scope_text = json.dumps(scope or {}, sort_keys=True)
    out: dict[str, str] = {}
    known = {p.value: p for p in partitions(spark, root, dataset, partition)}
    values = [r[0] for r in df.select(c(partition).cast("string")).distinct().collect()]  # one per partition
    for v in values:
        found = marker(spark, known[v]) if v in known else None
        if found is not None and not overwrite:
            if json.dumps(found.get("partition_scope", {}), sort_keys=True) != scope_text:
                raise ValueError(f"{dataset}/{partition}={v} was landed with another scope")
            out[v] = "skipped"
        else:
            out[v] = "written"
    fresh = [v for v, what in out.items() if what == "written"]
    if not fresh:
        return out
    rows = df.filter(c(partition).cast("string").isin(fresh))
    extra = sorted(set(df.columns) - set(columns) - {partition})
    own = [*columns, *extra]
    copy = "__" + partition  # the folder's column; the file keeps its own, if it is among the columns
    rows = rows.select(*[c(n) for n in own], c(partition).cast("string").alias(copy)).repartition(copy).sortWithinPartitions(copy, *keys)
    stage = f"{root}/staged-{dataset}"
    rows.withColumnRenamed(copy, "__p").write.mode("overwrite").option("header", "true").partitionBy("__p").csv(stage)
    fs_digest = {r.partition.split("=", 1)[-1]: r for r in digests(spark, root, f"staged-{dataset}").collect()}  # one per partition
    names = {r.value: r.identity for r in identity(df.filter(c(partition).cast("string").isin(fresh)), partition, keys).collect()}
    for v in fresh:
        target = f"{root}/{dataset}/{partition}={v}"
        files.delete(spark, target)
        fs, old = files._path(spark, f"{stage}/__p={v}")
        new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if not fs.rename(old, new):
            raise OSError(f"cannot move {target}")
        d = fs_digest[v]
        files.write_text(spark, f"{target}/{MARKER}",
            json.dumps({"rows": int(d.rows), "sha256": d.sha256, "identity_sha256": names[v], "partition_scope": scope or {}}, sort_keys=True))
    files.delete(spark, stage)
    return out


def complete_run(spark: SparkSession, root: str, date: str, datasets: dict[str, str]) -> bool:
    """Mark a date as wholly landed if each dataset's (name: partition key) partition of it verifies."""
    for dataset, key in datasets.items():
        if not any(p.value == date for p in partitions(spark, root, dataset, key)):
            return False
        bad = verified(spark, root, dataset, key).filter(c("partition") == f"{key}={date}").filter("problem IS NOT NULL").count()
        if bad:
            return False
    files.write_text(spark, f"{root}/run_complete/{date}.json", json.dumps({"date": date, "datasets": sorted(datasets)}))
    return True


def last_complete(spark: SparkSession, root: str) -> str:
    names = [e.name.removesuffix(".json") for e in files.listed(spark, f"{root}/run_complete/*.json")]
    return max(names, default="")


# ---- verification


def verified(spark: SparkSession, root: str, dataset: str, key: str, pattern: str = r"\d{8}", auxiliary: bool = False) -> DataFrame:
    """partition, rows, bytes, sha256 as found, the marker's, and the issue code of what is wrong (NULL: nothing). Files are hashed on executors."""
    found = partitions(spark, root, dataset, key)
    kind = "AUXILIARY" if auxiliary else "PARTITION"
    rows, scopes = [], []
    for p in found:
        problem, said_rows, said_sha, scope = None, None, None, None
        if not re.fullmatch(pattern, p.value):
            problem = "INVALID_PARTITION_DATE"
        elif p.bytes is None or p.marker_modified is None:
            problem = "AUXILIARY_MARKER_MISSING" if auxiliary and p.bytes is not None else "PARTITION_FILE_MISSING"
        else:
            try:
                m = json.loads(files.read_text(spark, f"{p.path}/{MARKER}"))
            except ValueError:
                m, problem = None, f"{kind}_MARKER_INVALID"
            if problem is None and not isinstance(m, dict):
                problem = f"{kind}_MARKER_SCHEMA_INVALID"
            elif problem is None:
                said_rows = m.get("rows") if isinstance(m.get("rows"), int) else -1
                said_sha, scope = str(m.get("sha256", "")), json.dumps(m["partition_scope"], sort_keys=True) if isinstance(m.get("partition_scope"),
                    dict) else None
        if scope is not None:
            scopes.append(scope)
        rows.append((p.name, p.value, problem, said_rows, said_sha, scope))
    schema = "partition string, value string, listed string, marker_rows long, marker_sha256 string, scope string"
    told = spark.createDataFrame(rows, schema)
    have = digests(spark, root, dataset) if any(p.bytes is not None for p in found) else spark.createDataFrame([],
        "partition string, rows long, bytes long, sha256 string")
    x = told.join(have, "partition", "left")
    first = F.lit(scopes[0] if scopes else None).cast("string")
    checks = F.array_compact(F.array(
        c("listed"), F.when(c("listed").isNull() & (c("marker_sha256") != c("sha256")), f"{kind}_HASH_MISMATCH"),
        *([] if auxiliary else [F.when(c("listed").isNull() & (c("marker_rows") != c("rows")), "PARTITION_ROW_COUNT_MISMATCH"),
        F.when(c("scope") != first, "PARTITION_SCOPE_MISMATCH")]),
    ))
    return x.withColumn("problems", checks).withColumn("problem", F.try_element_at("problems", F.lit(1)))


def partition_issues(spark: SparkSession, root: str, dataset: str, key: str, auxiliary: bool = False) -> DataFrame:
    """Issues of a dataset's partitions; of a missing dataset one."""
    if not partitions(spark, root, dataset, key):
        return spark.createDataFrame(
            [("KLINE_DATASET_MISSING", "ERROR", dataset, None, None, None, None, None, f"{key}=*", "none", None, f"{root}/{dataset}", None)], ISSUE_SCHEMA)
    v = verified(spark, root, dataset, key, r".+" if auxiliary else r"\d{8}", auxiliary).withColumn("issue_code", F.explode("problems"))
    none = F.lit(None)
    return v.select(
        "issue_code", F.lit("ERROR").alias("level"), F.lit(dataset).alias("dataset"), none.cast("string").alias("code"),
        F.try_to_date("value", "yyyyMMdd").alias("trade_date"), none.cast("date").alias("start_date"),
        none.cast("date").alias("end_date"),
        F.when(c("issue_code").endswith("HASH_MISMATCH"), "sha256").when(c("issue_code").endswith("ROW_COUNT_MISMATCH"), "rows").alias("field"),
        F.when(c("issue_code").endswith("ROW_COUNT_MISMATCH"), c("marker_rows").cast("string")).otherwise(c("marker_sha256")).alias("expected"),
        F.when(c("issue_code").endswith("ROW_COUNT_MISMATCH"), c("rows").cast("string")).otherwise(c("sha256")).alias("actual"),
        none.cast("string").alias("evidence"), c("partition").alias("source_file"), none.cast("long").alias("source_row"),
    )


def duplicate_dates(spark: SparkSession, root: str, dataset: str, key: str) -> list[str]:
    """Dates that two folders of a dataset stand for, whatever is written between their digits."""
    seen: dict[str, int] = {}
    for p in partitions(spark, root, dataset, key):
        digits = re.sub(r"\D", "", p.value)
        seen[digits] = seen.get(digits, 0) + 1
    return sorted(d for d, n in seen.items() if n > 1)


def staging_issues(spark: SparkSession, root: str) -> DataFrame:
    """Issues of staged batches kline_daily_<date>/batch_*.csv with batch_*.meta.json (rows, sha256)."""
    out: list[tuple] = []

    def add(code: str, date: str | None, path: str, expected=None, actual=None) -> None:
        out.append((code, "ERROR", "kline_1d", date, None if expected is None else str(expected), None if actual is None else str(actual), path))

    folders = [e for e in files.listed(spark, f"{root}/kline_daily_*") if e.folder]
    if not folders:
        add("KLINE_DATASET_MISSING", None, root)
    flat = {e.name.removesuffix(".csv") for e in files.listed(spark, f"{root}/kline_1d/batch_*.csv")}
    found = {}
    if folders:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "batch_*.csv").option("recursiveFileLookup",
            "true").load(root).filter(c("path").contains("/kline_daily_"))
        text = F.regexp_replace(c("content").cast("string"), "\n+$", "")
        tail = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
        found = {r.tail: r for r in raw.select(tail.alias("tail"), F.sha2("content", 256).alias("sha"),
            (F.size(F.split(text, "\n")) - 1).alias("rows")).collect()}  # one per batch file
    gaps = []
    for f in folders:
        date = f.name.removeprefix("kline_daily_")
        if not re.fullmatch(r"\d{8}", date):
            add("INVALID_PARTITION_DATE", None, f.path, "kline_daily_YYYYMMDD", f.name)
            continue
        names = [e.name for e in files.listed(spark, f"{f.path}/batch_*.csv")]
        if flat - {n.removesuffix(".csv") for n in names}:
            gaps.append(date)
        if not names:
            add("STAGING_BATCHES_MISSING", date, f.path)
        for n in names:
            got, meta = found[f"{f.name}/{n}"], f"{f.path}/{n.removesuffix('.csv')}.meta.json"
            if not files.exists(spark, meta):
                add("STAGING_BATCH_METADATA_MISSING", date, meta)
                continue
            try:
                m = json.loads(files.read_text(spark, meta))
            except ValueError:
                m = None
            if not isinstance(m, dict):
                add("STAGING_BATCH_METADATA_INVALID", date, meta)
                continue
            if m.get("rows") != got.rows:
                add("STAGING_BATCH_ROW_COUNT_MISMATCH", date, f"{f.path}/{n}", m.get("rows"), got.rows)
            if not m.get("sha256"):
                add("STAGING_BATCH_HASH_MISSING", date, meta)
            elif m["sha256"] != got.sha:
                add("STAGING_BATCH_HASH_MISMATCH", date, f"{f.path}/{n}", m["sha256"], got.sha)
    if gaps:
        add("STAGING_DAILY_BATCH_GAPS", None, root, f"{len(flat)} batches a day", f"{len(gaps)} days short")
    x = spark.createDataFrame(out, "issue_code string, level string, dataset string, d string, expected string, actual string, source_file string")
    return x.select("issue_code", "level", "dataset", F.try_to_date("d", "yyyyMMdd").alias("trade_date"), "expected", "actual", "source_file")


def staging_job(spark: SparkSession, root: str) -> str:
    """The one job folder below root/staging that has daily batches; ValueError (STAGING_JOB_AMBIGUOUS) if there are several."""
    jobs = [e.path for e in files.listed(spark, f"{root}/staging/*") if e.folder and files.listed(spark, f"{e.path}/kline_daily_*")]
    if len(jobs) > 1:
        raise ValueError(f"STAGING_JOB_AMBIGUOUS: {len(jobs)} jobs")
    return jobs[0] if jobs else ""
