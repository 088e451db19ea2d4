"""Token ids in wavelet-matrix files: one succinct, indexed file per shard of documents.

A shard is a run of whole documents in ascending (doc_id) order, closed once it
holds SHARD_TOKENS ids. Its ids are renumbered by rank in the shard's own sorted
alphabet and stored as a wavelet matrix: one bit plane per bit, most significant
first, each plane's ids stably split zeros first, with running counts of ones every
512 bits. access, rank, select, occurrence lookup and whole decoding all work on
the compressed file. Files are written by Spark, one shard a file, so that any
store Spark writes to will do; shards that a task had to retry are simply rewritten.

Null and empty texts are a document of the end id alone; repeated ids are documents of their own.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, WORD, SpanHashes, gathered, partitions, shared_dir, table, text_slices, tidy, words
from .vocabulary import WordCodes

SHARD_TOKENS = 1 << 22
END_ID = 1
_MAGIC = b"WAVM0002"
_STEP = 512


class WaveletMatrix:
    """Rank/select sequence over the ids of `alphabet`; bits: one packed plane per level."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.alphabet, self.planes = n, alphabet, planes
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane).astype(np.uint32)
        ones = np.pad(ones, (0, -len(ones) % (_STEP // 8)))
        return np.concatenate([[0], np.cumsum(ones.reshape(-1, _STEP // 8).sum(1, dtype=np.uint32), dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        used = np.zeros(int(ids.max(initial=0)) + 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        code = np.zeros(len(used), kind)
        code[alphabet] = np.arange(len(alphabet))
        x, planes = code[ids], []
        for level in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
            bit = (x & kind(1 << level)) != 0
            planes.append(np.packbits(bit))
            x = np.concatenate([x[~bit], x[bit]])
        return cls(len(ids), alphabet, planes)

    def _rank1(self, level: int, i: int) -> int:
        block = i // _STEP
        plane = self.planes[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * _STEP // 8 : i // 8]).sum())
        return count + (bin(int(plane[i // 8]) >> (8 - i % 8)).count("1") if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, low: int, high: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if code >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often token stands before position i."""
        code = self._code(token)
        if code is None:
            return 0
        low, high = self._range(code, 0, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * _STEP, self.n) - ranks
        block = int(np.searchsorted(ranks, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * _STEP // 8 : (block + 1) * _STEP // 8])[: self.n - block * _STEP]
        return block * _STEP + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of token; IndexError beyond the last."""
        code = self._code(token)
        if code is None or k < 0 or k >= self.count(token):
            raise IndexError((token, k))
        i = self._range(code, 0, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the last one up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[~bit] = x[: self.zeros[level]]
            up[bit] = x[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            x = up
        return self.alphabet[x]


def pack(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """File: magic; counts of documents, ids, alphabet, planes; null flags, doc ids, sizes; alphabet; planes, each with its rank counts."""
    w = WaveletMatrix.build(ids)
    null = np.array([x is None for x in doc_ids], np.uint8)
    parts = [_MAGIC, struct.pack("<4q", len(doc_ids), w.n, len(w.alphabet), len(w.planes)), null.tobytes(),
             np.array([x or 0 for x in doc_ids], "<i8").tobytes(), sizes.astype("<i8").tobytes(), w.alphabet.astype("<u4").tobytes()]
    for plane, rank in zip(w.planes, w.ranks, strict=True):
        parts += [plane.tobytes(), rank.astype("<u4").tobytes()]
    return b"".join(parts)


def unpack(raw: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(doc ids, sizes, matrix) of a file."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a wavelet matrix file")
    docs, n, letters, levels = struct.unpack_from("<4q", raw, 8)
    at = 40

    def read(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, count, at)
        at += x.nbytes
        return x

    null, ids, sizes, alphabet = read("u1", docs), read("<i8", docs), read("<i8", docs), read("<u4", letters)
    planes, ranks = [], []
    for _ in range(levels):
        planes.append(read("u1", -(-n // 8)))
        ranks.append(read("<u4", -(-n // _STEP) + 1))
    return [None if z else int(x) for z, x in zip(null, ids, strict=True)], sizes, WaveletMatrix(n, alphabet, planes, ranks)


def _verified(tokenizer, c: str, kind: int) -> bool:
    """Whether c beside letters, digits and punctuation is cut where (and only where) its kind changes."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for other, x in ((1, "a"), (2, "7"), (3, "!")):
        for left, right in ((c, x), (x, c)):
            if kind != other and ids(left + right) != ids(left) + ids(right):
                return False
    if kind == 3:  # punctuation that starts a contraction joins letters
        return all(ids(c + x) == ids(c) + ids(x) for x in ("s", "t", "re", "ve", "m", "ll", "d"))
    return kind != 1 or all(len(tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(x))) == 1 for x in (c + "a", "a" + c, c + c))


class Runs:
    """The places at which a tokenizer splits any text, found by trying each character on it.

    It must drop white space and never join across it. Letters (ASCII and two-byte), ASCII digits
    and ASCII punctuation that it cuts from each other are runs; a word with any other
    character is given to it whole.
    """

    def __init__(self, tokenizer):
        special = {t.content[0] for t in tokenizer.get_added_tokens_decoder().values()}
        self.kind = np.full(256, 1, np.uint8)
        self.odd = np.ones(256, bool)
        self.odd[0xC2:0xE0] = False  # lead bytes: judged with the next one
        self.odd[0x80:0xC0] = False
        self.pairs = np.ones((32, 64), bool)
        for code in [*range(33, 127), *range(0x80, 0x800)]:
            c = chr(code)
            kind = {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3)
            fine = c not in special and not c.isspace() and (code < 127 or kind == 1) and _verified(tokenizer, c, kind)
            if code < 127:
                self.kind[code], self.odd[code] = kind, not fine
            else:
                self.pairs[(code >> 6), code & 63] = not fine
        self.kind[~WORD] = 0

    def oddities(self, data: np.ndarray) -> np.ndarray:
        odd = self.odd[data]
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
        odd[lead] = self.pairs[data[lead] & 31, data[lead + 1] & 63]
        return odd

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, ASCII letters of runs in lower case; starts, ends, first of each document) of the runs; a text's ids are those of its runs in a row."""
        start, end, first = words(data, off)
        if not len(start):
            return data, start, end, first
        upto = np.zeros(len(data) + 1, np.int32)
        np.cumsum(self.oddities(data), out=upto[1:])
        whole = upto[end] > upto[start]
        kind = self.kind[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        folded = LOWER[data]
        for s, e in zip(start[whole].tolist(), end[whole].tolist(), strict=True):
            cut[s:e] = False
            folded[s:e] = data[s:e]
        cut[start] = True
        starts = np.flatnonzero(cut)
        return folded, starts, _ends(starts, start, end, len(data)), np.searchsorted(starts, off)


def _ends(starts: np.ndarray, word_start: np.ndarray, word_end: np.ndarray, n: int) -> np.ndarray:
    """Where each run ends: at the next run's start or its word's end."""
    word = np.zeros(n, np.int32)
    word[word_start] = 1
    return np.minimum(np.append(starts[1:], n), word_end[np.cumsum(word)[starts] - 1])


class ShardEncoder:
    """Ids of runs by the tokenizers library, each different run once while its cache holds it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.last[i] = piece.endswith("</w>")
        self.kind = np.uint16 if len(self.last) <= 1 << 16 else np.uint32
        self.runs = Runs(self.tokenizer)
        self.codes = WordCodes(self._encode, self.kind)

    def _one_by_one(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)

    def _letters(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, in one call: the last id of each run, and no other, ends a word."""
        line = np.full(len(raw) + len(size), 32, np.uint8)
        line[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
        text = line.tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(size):
            return self._one_by_one(text.split(" ")[:-1])
        return ids, np.diff(stops, prepend=0)

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        raw = gathered(data, start, size)
        begin = np.cumsum(size) - size
        plain = (self.runs.kind[raw[begin]] == 1) & ~np.logical_or.reduceat(self.runs.oddities(np.append(raw, np.uint8(0)))[:-1], begin)
        ids, sizes = self._letters(gathered(raw, begin[plain], size[plain]), size[plain]) if plain.any() else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        whole = raw.tobytes()
        more, more_sizes = self._one_by_one([whole[b : b + n].decode() for b, n in zip(begin[~plain].tolist(), size[~plain].tolist(), strict=True)])
        counts, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        counts[plain], counts[~plain] = sizes, more_sizes
        at[plain], at[~plain] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(more_sizes) - more_sizes
        return gathered(np.concatenate([ids, more]), at, counts), counts

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids per document)."""
        folded, start, end, first = self.runs(data, off)
        ids, per_run = self.codes(folded, start, end, SpanHashes(folded)(start, end))
        upto = np.concatenate([[0], np.cumsum(per_run)])[first]
        return ids, np.diff(upto)


@functools.lru_cache(maxsize=1)
def shard_encoder(path: str) -> ShardEncoder:
    """One per worker process: tasks share the tokenizer and its cache."""
    return ShardEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS, slices: int | None = None) -> None:
    """Write docs (doc_id, text) as wavelet-matrix files under path, ids ascending along shards (null first)."""
    n = slices or partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n,
        F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches):
        from pyspark import TaskContext

        encoder = shard_encoder(tokenizer)
        task, number, held, ids, sizes = TaskContext.get().partitionId(), 0, 0, [], []
        names: list = []

        def close():
            nonlocal number, held, ids, sizes, names
            whole, size = np.concatenate(ids), np.concatenate(sizes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(whole)], pa.int64()),
                pa.array([pack(names, size, whole)], pa.binary())],
                ["task", "number", "n_docs", "n_tokens", "payload"],
            )
            number, held, ids, sizes, names = number + 1, 0, [], [], []
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, data, off in text_slices(batch.column(1)):
                got, counts = encoder(data, off)
                ids.append(np.insert(got, np.cumsum(counts), END_ID))
                sizes.append(counts + 1)
                names += doc_ids[i:j]
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield close()
        if names:
            yield close()

    ordered.mapInArrow(tidy(run), "task int, number int, n_docs long, n_tokens long, payload binary").write.option("compression",
        "uncompressed").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    shards = spark.read.parquet(path)
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("task", "number", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("task",
        "number", "before")

    def run(batches):
        for batch in batches:
            for task, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, sizes, matrix = unpack(raw.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(begins), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64()),
                    pa.array([task] * len(crc), pa.int32()), pa.array([number] * len(crc), pa.int32())],
                    ["doc_id", "inside", "n_tokens", "ids_crc32", "task", "number"],
                )

    docs = shards.select("task", "number", "payload").mapInArrow(tidy(run), "doc_id long, inside long, n_tokens long, ids_crc32 long, task int, number int")
    return docs.join(starts, ["task", "number"]).select("doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        F.struct("task", "number").alias("shard"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/barsmith/wavelet-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_shards(spark, path)
