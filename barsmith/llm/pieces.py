"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is taken as the model takes it: a space in front, each space as U+2581.
No piece has a space after another character, so merges never cross from a
word into the next run of spaces: "spaces + word" is segmented by itself. Its
merges are processed by an agenda (best score, then leftmost); a candidate is
dropped when its keyed hash of (seed, document, run, left end, right end)
falls below the dropout rate. So segmentation is stable over reruns and partitionings,
and a word is cut anew in every document (alike within one). Characters without
a piece become bytes. Dropped or not, pieces always spell the text, so decoding
returns it exactly.

Null and empty texts have no ids; a null id counts as 0 in the key; rows are encoded one by one,
equal rows alike; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SpanHashes, gathered, mix, per_document, table, text_slices, tidy
from .vocabulary import HashIndex

SEED, DROPOUT = 20260816, 0.1
#: Runs up to each width (code points) share a matrix of at most ROWS rows; longer ones have an agenda of their own.
WIDTHS, ROWS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 28, 48), 1 << 15
_BLANK = "▁"
_M64 = (1 << 64) - 1


class Pieces:
    """A BPE model's pieces: ids and merge ranks by string, bytes by id."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.bytes_of.append(piece.replace(_BLANK, " ").encode())

    def segment(self, word: str, key: int, dropout: float) -> list[int]:
        """Ids of one "spaces + word" run; key: 64 bits of seed, document and run."""
        word = word.replace(" ", _BLANK)
        n = len(word)
        text: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, least = self.score, int(dropout * 2**32)
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (s := score.get(both := text[a] + text[b])) is not None:
                if least:
                    h = (key ^ (a * 0x9E3779B97F4A7C15) ^ ((b + len(text[b])) * 0xC2B2AE3D27D4EB4F)) & _M64
                    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & _M64
                    h = (h ^ (h >> 29)) * 0x94D049BB133111EB & _M64
                    if h >> 32 < least:
                        return
                heapq.heappush(agenda, (-s, a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if text[a] is None or b >= n or text[b] is None or after[a] != b or text[a] + text[b] != both:
                continue
            text[a], text[b] = both, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for piece in text:
            if piece is not None:
                i = self.ids.get(piece)
                out += [i] if i is not None else [self.byte_id[x] for x in piece.encode()]
        return out

    @functools.cached_property
    def _merges(self) -> tuple[HashIndex, np.ndarray, np.ndarray, np.ndarray]:
        """(index of left << 32 | right, their merged ids, merge order by number in it, id or -3 - code point by code point)."""
        found = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        scores = sorted(set(self.score.values()), reverse=True)
        place = dict(zip(scores, range(len(scores)), strict=True))
        order = np.zeros(len(self.bytes_of), np.int32)
        letters = -3 - np.arange(0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            order[i] = place[self.score[piece]]
            if len(piece) == 1:
                letters[ord(piece)] = i
        index = HashIndex(max(len(found), 1).bit_length() + 2)
        index.add(np.fromiter(found, np.uint64, len(found)))
        merged = np.fromiter(found.values(), np.int32, len(found))
        return index, merged, order[merged] if len(merged) else np.zeros(0, np.int32), letters

    def segment_all(self, points: np.ndarray, size: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """segment() of many runs at once. points: code points of all runs; (all ids, ids per run).

        Runs of like length are rows of a matrix of symbols, with one agenda a row: each round takes the
        best live candidate of every row (leftmost on ties), shifts the row over it, and offers its two new neighbours.
        """
        begin = np.cumsum(size) - size
        symbols = self._merges[3][points]
        held, where = [], np.zeros(len(size), np.int64)
        counts = np.zeros(len(size), np.int64)
        used = 0
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(rows), ROWS):
                part = rows[k : k + ROWS]
                for row, flat, n in self._agendas(symbols, begin[part], size[part], keys[part], int(size[part].max()), dropout):
                    row = part[row]
                    where[row], counts[row] = used + np.cumsum(n) - n, n
                    held.append(flat)
                    used += len(flat)
        for i in np.flatnonzero(size > low).tolist():
            word = points[begin[i] : begin[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le")
            held.append(np.array(self.segment(word, int(keys[i]), dropout), np.int32))
            where[i], counts[i] = used, len(held[-1])
            used += len(held[-1])
        ids = gathered(np.concatenate(held) if held else np.zeros(0, np.int32), where, counts)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, counts
        spelt = [[self.byte_id[x] for x in chr(-3 - c).encode()] for c in ids[lost].tolist()]
        grown = np.ones(len(ids), np.int64)
        grown[lost] = [len(x) for x in spelt]
        ends = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], np.cumsum(grown)])
        ids = np.repeat(ids, grown)
        for at, x in zip(upto[lost].tolist(), spelt, strict=True):
            ids[at : at + len(x)] = x
        return ids, np.diff(upto[ends])

    def _agendas(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, keys: np.ndarray, width: int, dropout: float):
        """Yields (rows, their symbols concatenated, symbols per row) as rows run out of candidates."""
        index, merged, order, _ = self._merges
        never, least = np.int32(2**31 - 1), np.uint64(int(dropout * 2**32))
        inside = np.arange(width) < size[:, None]
        symbol = np.full((len(size), width), -2, np.int32)
        symbol[inside] = gathered(symbols, begin, size)
        stop = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), symbol.shape).copy()
        row = np.arange(len(size))

        def offers(left, right, start, end, key) -> tuple[np.ndarray, np.ndarray]:
            """(merge order, merged id) of candidates; those without a piece or dropped never come up."""
            both = np.flatnonzero((left >= 0) & (right >= 0))
            number = index.find(left[both].astype(np.uint64) << np.uint64(32) | right[both].astype(np.uint64))
            real = number >= 0
            both, number = both[real], number[real]
            if least:
                h = key[both] ^ start[both].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ end[both].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                stay = (h >> np.uint64(32)) >= least
                both, number = both[stay], number[stay]
            best, into = np.full(len(left), never), np.zeros(len(left), np.int32)
            best[both], into[both] = order[number], merged[number]
            return best, into

        shape = (len(size), width - 1)
        best, into = offers(
            symbol[:, :-1].reshape(-1), symbol[:, 1:].reshape(-1), np.broadcast_to(np.arange(width - 1), shape).reshape(-1), stop[:, 1:].reshape(-1),
            np.repeat(keys, width - 1)
        )
        best, into = best.reshape(shape), into.reshape(shape)
        while True:
            if symbol.shape[1] > 1:
                at = best.argmin(1)
                live = best[np.arange(len(row)), at] != never
            else:
                live = np.zeros(len(row), bool)
            if not live.all():
                out = symbol[~live]
                real = out != -2
                yield row[~live], out[real], real.sum(1)
                if not live.any():
                    return
                symbol, stop, best, into, keys, row, at = symbol[live], stop[live], best[live], into[live], keys[live], row[live], at[live]
            n = np.arange(len(row))
            symbol[n, at] = into[n, at]
            stop[n, at] = stop[n, at + 1]
            stay = np.ones(symbol.shape, bool)
            stay[n, at + 1] = False
            symbol, stop = symbol[stay].reshape(len(row), -1), stop[stay].reshape(len(row), -1)
            stay = np.ones(best.shape, bool)
            stay[n, at] = False
            best, into = best[stay].reshape(len(row), -1), into[stay].reshape(len(row), -1)
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left < best.shape[1]))
                if len(some):
                    x = left[some]
                    start = np.where(x > 0, stop[some, x - 1], 0)
                    best[some, x], into[some, x] = offers(symbol[some, x], symbol[some, x + 1], start, stop[some, x + 1], keys[some])

    def decode(self, ids) -> str:
        raw = b"".join(self.bytes_of[i] for i in ids)
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all piece bytes, start, length by id)."""
        size = np.array([len(x) for x in self.bytes_of])
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(size) - size, size


def _with_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of each that is not empty."""
    full = np.flatnonzero(off[1:] > off[:-1])
    out = np.insert(data, off[full], 32)
    grow = np.zeros(len(off), np.int64)
    grow[full + 1] = 1
    return out, off + np.cumsum(grow)


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first of each document) of maximal "spaces + other characters" runs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    blank = data == 32
    lead = np.zeros(n, bool)
    lead[1:] = blank[1:] & ~blank[:-1]
    lead[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(lead)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, off)


def run_keys(spans: np.ndarray, doc_ids: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of seed, document and run."""
    return mix(spans ^ mix(doc_ids.astype(np.uint64) + mix(np.array([seed], np.uint64))))


class Encoder:
    def __init__(self, model: bytes, seed: int = SEED, dropout: float = DROPOUT):
        self.pieces, self.seed, self.dropout = Pieces(model), seed, dropout

    def __call__(self, data: np.ndarray, off: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all documents, ids per document, whether each decodes to its own text)."""
        spaced, at = _with_space(data, off)
        start, end, first = runs(spaced, at)
        keys = run_keys(SpanHashes(spaced)(start, end), np.repeat(doc_ids, np.diff(first)), self.seed)
        # equal runs of one document are cut alike, so each is segmented once
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        raw = gathered(spaced, start[one], (end - start)[one])
        points = np.frombuffer(raw.tobytes().decode().replace(" ", _BLANK).encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((spaced & 0xC0) != 0x80)])
        got, per_run = self.pieces.segment_all(points, (lead[end] - lead[start])[one], keys[one], self.dropout)
        begin = (np.cumsum(per_run) - per_run)[which]
        per_run = per_run[which]
        ids = gathered(got, begin, per_run)
        counts = per_document(per_run, first)
        pool, begin, size = self.pieces.table
        lengths = size[ids]
        spelt = gathered(pool, begin[ids], lengths)
        if len(spelt) == len(spaced) and (spelt == spaced).all():
            exact = np.ones(len(counts), bool)
        else:
            ends, lead = np.cumsum(counts), np.concatenate([[0], np.cumsum(lengths)])
            exact = np.array([spelt[lead[e - c] : lead[e]].tobytes() == spaced[a:b].tobytes() for e, c, a, b in zip(ends, counts, at[:-1], at[1:],
                strict=True)], bool)
        return ids, counts, exact


@functools.lru_cache(maxsize=1)
def _encoder(model: bytes, seed: int, dropout: float) -> Encoder:
    """One per worker process."""
    return Encoder(model, seed, dropout)


SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decodes boolean, ids array<int>"


def encode(docs: DataFrame, model_path: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """Per row of docs (doc_id, text): ids, their number, crc32 (little-endian unsigned 32-bit) and whether they decode to the text."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(model.value, seed, dropout)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(batch.column(1)):
                ids, counts, exact = encoder(data, off, doc_ids[i:j])
                ids = ids.astype("<i4")
                ends = np.concatenate([[0], np.cumsum(counts)])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts), pa.array(crc, pa.int64()), pa.array(exact),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    ["doc_id", "n_tokens", "ids_crc32", "decodes", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
