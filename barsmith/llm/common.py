"""Shared pieces of the corpus operators: table access, scratch tables, byte arithmetic.

Texts are handled as UTF-8 bytes in numpy, a slice of whole documents at a
time, so an operator's memory follows SLICE_BYTES (or its longest single
document), not the batch or partition that Spark hands over.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..scratch import shared_dir
from ..shipping import ship
from ..sources import files

SLICE_BYTES = 1 << 20
_M64 = (1 << 64) - 1

#: Bytes 0x09-0x0D and 0x20 separate words everywhere in this package.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCOPES: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barsmith/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barsmith_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete stored() tables that no later plan reads."""
    for df in frames:
        files.delete(df.sparkSession, df._barsmith_path)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables stored() inside are deleted at the end: for work whose result has been written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop_stored(*_SCOPES.pop())


def tidy(run: Callable) -> Callable:
    """run (an Arrow batch function) that hands the memory it freed back to the system when its task ends.

    Python workers outlive tasks; without this each keeps the most that any of its tasks held.
    As every such function passes here on the driver, this also ships the package to the executors.
    """
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc: nothing to trim
                pass

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about `size` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    off = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        base = np.full(max(n, SLICE_BYTES + 4096), _B if kind == "up" else _BI, np.uint64)
        base[0] = 1
        _POWERS[kind] = np.multiply.accumulate(base)
    return _POWERS[kind]


class SpanHashes:
    """64-bit hashes of any spans of one slice (bytes; 64-bit numbers if codes is None), from one prefix sum of a polynomial mod 2**64."""

    def __init__(self, data: np.ndarray, codes: np.ndarray | None = _CODE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data if codes is None else codes[data]) * _powers("up", n + 1)[:n], out=self.sums[1:])
        self.down = _powers("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + end.astype(np.uint64) - start.astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of maximal runs of word bytes within documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = is_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[0] = after[-1] = False
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start[i]:start[i] + length[i]] for all i, concatenated."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(length)
    at = np.arange(total) + np.repeat(start - (ends - length), length)
    return pool[at]


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is connected with by links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
