"""Small files of any store that Spark writes to, by Hadoop's file system: listings, markers and locks of the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    bytes: int
    modified: int
    folder: bool


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, pattern: str) -> list[Entry]:
    """Entries that match a glob, in order of path; none if nothing does."""
    fs, p = _path(spark, pattern)
    found = fs.globStatus(p)
    out = [Entry(str(x.getPath().toString()), x.getPath().getName(), x.getLen(), x.getModificationTime(), x.isDirectory()) for x in found or []]
    return sorted(out, key=lambda e: e.path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str, limit: int = (1 << 31) - 1) -> str:
    """The text of a small file, or the first `limit` bytes of any."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(limit)).decode(errors="strict" if limit > 1 << 30 else "ignore")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """Write a small file by way of a temporary one and a rename; new: only if there is none (False if there is)."""
    fs, p = _path(spark, path)
    if new:
        try:
            stream = fs.create(p, False)
        except Exception as e:  # py4j wraps the store's own "already exists"
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(half, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(half, p):
        raise OSError(f"cannot write {path}")
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
