"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else are removed.

Sampling. Of each window of LENGTH bytes the least-hashed CORE-byte string (leftmost on
ties) is its anchor. Equal windows have the same anchor at the same place, so windows can
only be equal if their anchors' strings are. An anchor with all the windows it serves is one
row: (doc, at, least and most bytes that those windows reach left of it).

Classes. Anchors whose whole neighbourhoods (all windows served) are equal form a class,
counted before any text moves: two members or more settle all their windows. One
representative of each class goes on where its anchor string occurs in other classes too.

Sorting. Neighbourhoods of one anchor string are two sets of strings: what follows the
anchor, and what precedes it, reversed. Both are sorted deep-shallow: multikey quicksort on
eight-byte characters to SHALLOW bytes, then a blind trie for each group still equal there.
Sorting yields longest common prefixes with neighbours. The window reaching l bytes left
is repeated iff another row shares l bytes before and LENGTH - l after the anchor; that
holds alike between two neighbouring break points, so each such interval is decided by counting rows
by (class before, class after).

Hot anchors. An anchor string with more than GROUP classes is split by content: by what its windows
share when they are taken GRAINS[k] at a time, with fresh classes each time; at one window a
row, equality of the class is the answer. So no task sees more than GROUP rows of an anchor.

Hashes only find candidates for sorting, except that classes of whole equal neighbourhoods are told
by two 64-bit hashes. Null texts are empty. Where ids repeat or are null, documents are told
apart by a hash of id and text instead; fully equal rows share it, and each removes what the other repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHashes, drop_stored, gathered, partitions, per_document, stored, table, text_slices, tidy, words

LENGTH, CORE = 400, 100
WINDOW_WORDS, CORE_WORDS = 50, 25
SHALLOW = 64
GROUP = 200
GRAINS = (32, 1)
_PLACES = 1 << 26


def anchors(n: int, length: int, core: int, spans: SpanHashes, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, least, most) of the n places from base on: anchors and how far their windows reach to the left of them."""
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    w = length - core + 1
    at = np.arange(base, base + n - core + 1)
    packed = (spans(at, at + core) & ~np.uint64(_PLACES - 1)) | np.arange(len(at), dtype=np.uint64)
    pad = np.full(-len(packed) % w + w, np.iinfo(np.uint64).max, np.uint64)
    grid = np.concatenate([packed, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    chosen = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(_PLACES - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], windows) - 1
    return chosen[first], chosen[first] - last, chosen[first] - first


_ROWS = "key long, seg1 long, seg2 long, doc long, at long, least int, most int, rows int, reach int"


def _row(keys, one, two, doc, at, least, most, length: int) -> pa.RecordBatch:
    """Neighbouring rows of one class in one document whose windows overlap (runs of a byte or a short period) are one: `rows` of them, the last
    `reach` bytes on."""
    new = np.ones(len(at), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x[first].view(np.int64)) for x in (keys, one, two)), pa.array(doc[first]), pa.array(at[first]),
        *(pa.array(x, pa.int32()) for x in (least[first], most[first], last - first + 1, at[last] - at[first]))],
        ["key", "seg1", "seg2", "doc", "at", "least", "most", "rows", "reach"],
    )


def _hash_rows(spans: SpanHashes, base, at, least, most, doc, length: int, core: int, shared: bool) -> pa.RecordBatch:
    """Rows with the key that windows of a row share (the anchor's core, or all that its windows have in common) and their class."""
    begin, end = base + at - most, base + at - least + length
    if shared:
        keys = spans(base + at - least, base + at - most + length) * np.uint64(3) + most.astype(np.uint64)
    else:
        keys = spans(base + at, base + at + core)
    whole = spans(begin, end)
    place = most.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64)
    return _row(keys, whole + place, spans(base + at - least, end) ^ (spans(begin, base + at) + place), doc, at, least, most, length)


def _listed(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets of each row's list, the lists' fields) of a list column of structs; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    return offsets, [flat.field(k).to_numpy(zero_copy_only=False) for k in (flat.type.get_field_index(n) for n in names)]


def _anchor_rows(length: int, core: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(batch.column(1)):
                spans = SpanHashes(data)
                found = []
                for d in range(j - i):
                    a, b = int(off[d]), int(off[d + 1])
                    step = _PLACES - length
                    for s in range(a, b, step):
                        at, least, most = anchors(min(b - s, step + length - 1), length, core, spans, s)
                        if len(at):
                            found.append((np.full(len(at), s), at + s - a, least, most, np.full(len(at), ids[i + d]), np.full(len(at), a)))
                if found:
                    _, at, least, most, doc, base = map(np.concatenate, zip(*found, strict=True))
                    yield _hash_rows(spans, base, at, least, most, doc, length, core, False)

    return run


def _refined(length: int, core: int, grain: int):
    """Rows of documents' listed anchors, cut into rows of at most `grain` windows each (aligned by reach)."""

    def run(batches):
        for batch in batches:
            lists, (at, least, most) = _listed(batch.column(2), ("at", "least", "most"))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(batch.column(1)):
                spans = SpanHashes(data)
                owner = np.repeat(np.arange(i, j), np.diff(lists[i : j + 1]))
                here = slice(lists[i], lists[j])
                low, high = least[here] // grain, most[here] // grain
                pieces = high - low + 1
                k = np.repeat(np.arange(len(owner)), pieces)
                block = (np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + low[k]) * grain
                if len(k):
                    yield _cut_rows(
                        spans, off[owner[k] - i], at[here][k], np.maximum(block, least[here][k]).astype(np.int64),
                        np.minimum(block + grain - 1, most[here][k]).astype(np.int64), ids[owner[k]], length, grain
                    )

    return run


def _cut_rows(spans: SpanHashes, base, at, least, most, doc, length: int, grain: int) -> pa.RecordBatch:
    """As _hash_rows; the key is what all windows of the aligned block share, which does not depend on a row's own bounds."""
    low = most // grain * grain
    high = low + grain - 1
    keys = spans(base + at - low, base + at - high + length) * np.uint64(3) + low.astype(np.uint64)
    begin, end = base + at - most, base + at - least + length
    place = most.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64)
    return _row(keys, spans(begin, end) + place, spans(base + at - least, end) ^ (spans(begin, base + at) + place), doc, at, least, most, 0)


# ---- deep-shallow sorting


def _common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least start."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while low < high and a[low] == b[low]:
        low += 1
    return low


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.kids, self.leaf = depth, {}, leaf


def blind_trie(strings: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """ids in order of their (different) strings, and the common prefix of each with the one before it (the first: 0).

    Branches hold only the place and the byte at which their strings part; the place at which a new string
    leaves the trie is found by one comparison with any string of the branch that a blind descent ends in.
    """
    root = _Node(len(strings[ids[0]]), ids[0])
    for i in ids[1:]:
        s, node = strings[i], root
        while node.kids and node.depth <= len(s):
            after = node.kids.get(s[node.depth] if node.depth < len(s) else -1)
            if after is None:
                break
            node = after
        depth = _common(s, strings[node.leaf])
        node, above, label = root, None, 0
        while node.kids and node.depth < depth:
            above, label = node, s[node.depth] if node.depth < len(s) else -1
            node = node.kids[label]
        if node.kids and node.depth == depth:
            node.kids[s[depth] if depth < len(s) else -1] = _Node(len(s), i)
            continue
        other = strings[node.leaf]
        branch = _Node(depth, node.leaf)
        branch.kids[other[depth] if depth < len(other) else -1] = node
        branch.kids[s[depth] if depth < len(s) else -1] = _Node(len(s), i)
        if above is None:
            root = branch
        else:
            above.kids[label] = branch
    order: list[int] = []
    shared: list[int] = []
    todo, parted = [(root, 0)], 0
    while todo:
        node, entry = todo.pop()
        if not node.kids:
            order.append(node.leaf)
            shared.append(entry)
            continue
        kids = sorted(node.kids.items(), reverse=True)
        todo += [(kid, node.depth) for _, kid in kids[:-1]]
        todo.append((kids[-1][1], entry))
    return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, common prefix with the predecessor) of different strings: multikey quicksort, then blind tries."""
    order: list[int] = []
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while todo:
        ids, depth = todo.pop()
        if len(ids) == 1:
            order.append(ids[0])
            continue
        if depth >= shallow:
            order += blind_trie(strings, ids)[0]
            continue
        chars = [(strings[i][depth : depth + 8], min(len(strings[i]) - depth, 8)) for i in ids]
        pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
        less = [i for i, c in zip(ids, chars, strict=True) if c < pivot]
        more = [i for i, c in zip(ids, chars, strict=True) if c > pivot]
        same = [i for i, c in zip(ids, chars, strict=True) if c == pivot]
        for part, d in ((more, depth), (same, depth + 8), (less, depth)):
            if part:
                todo.append((part, d))
    return order, [0] + [_common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def _sorted_breaks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in order of each string, equal strings alike; common prefix of each place with the one before it)."""
    different: dict[bytes, int] = {}
    which = [different.setdefault(s, len(different)) for s in strings]
    order, shared = deep_shallow(list(different))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[which], np.array(shared, np.int64)


def repeated(before: list[bytes], after: list[bytes], least: np.ndarray, most: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each row the intervals [low, high] of reaches l whose window another row has too.

    before: bytes left of the anchor, reversed (most of them); after: those from it on (length - least).
    """
    place_b, shared_b = _sorted_breaks(before)
    place_a, shared_a = _sorted_breaks(after)
    points = {int(least.min()), *(least + 0).tolist(), *(most + 1).tolist()}
    points |= {int(x) + 1 for x in shared_b[1:]} | {length - int(x) for x in shared_a[1:]}
    points = sorted(p for p in points if least.min() <= p <= most.max())
    out: list[list[tuple[int, int]]] = [[] for _ in before]
    top = int(most.max())
    for k, low in enumerate(points):
        high = points[k + 1] - 1 if k + 1 < len(points) else top
        rows = np.flatnonzero((least <= low) & (most >= low))
        if len(rows) < 2:
            continue
        b = np.cumsum(shared_b < low)[place_b[rows]]
        a = np.cumsum(shared_a < length - low)[place_a[rows]]
        _, which, count = np.unique(b * (len(shared_a) + 2) + a, return_inverse=True, return_counts=True)
        for r in rows[count[which.reshape(-1)] > 1].tolist():
            if out[r] and out[r][-1][1] == low - 1:
                out[r][-1] = (out[r][-1][0], high)
            else:
                out[r].append((low, high))
    return out


def _segments(length: int):
    """The neighbourhoods of documents' listed anchors."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists, (key, at, least, most) = _listed(batch.column(2), ("key", "at", "least", "most"))
            for i, j, data, off in text_slices(batch.column(1)):
                owner = np.repeat(np.arange(i, j), np.diff(lists[i : j + 1]))
                for k in range(0, len(owner), 4096):
                    here = slice(lists[i] + k, min(lists[i] + k + 4096, lists[j]))
                    own = owner[k : k + 4096]
                    size = (most[here] - least[here]).astype(np.int64) + length
                    raw = gathered(data, off[own - i] + at[here] - most[here], size)
                    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                    segments = pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[here]), pa.array(ids[own]), pa.array(at[here]), pa.array(least[here], pa.int32()),
                        pa.array(most[here], pa.int32()), segments], ["key", "doc", "at", "least", "most", "raw"]
                    )

    return run


_SPANS = "doc long, s long, e long"


def _decide(length: int):
    """Removed spans of rows sorted by key, one anchor string at a time."""

    def run(batches):
        held: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def close():
            if len(held) > 1:
                least, most = np.array([x[3] for x in held]), np.array([x[4] for x in held])
                before = [x[5][: x[4]][::-1] for x in held]
                after = [x[5][x[4] :] for x in held]
                for x, spans in zip(held, repeated(before, after, least, most, length), strict=True):
                    out.extend((x[1], x[2] - high, x[2] - low + length) for low, high in spans)
            held.clear()

        def flush():
            d, s, e = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (d, s, e)], ["doc", "s", "e"])

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != x[0]:
                    close()
                    if len(out) > 20_000:
                        yield flush()
                held.append(x)
        close()
        if out:
            yield flush()

    return run


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc, text, x: rows of each document as a list of structs (key, at, least, most)."""
    lists = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "at", "least", "most")).alias("x"))
    return docs.join(lists, "doc").select("doc", "text", "x")


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE, group: int = GROUP, grains: tuple = GRAINS) -> DataFrame:
    """Spans (doc, s, e) that cover exactly the bytes in strings of `length` that start twice or more; docs: doc (unique), text."""
    rows = stored(docs.mapInArrow(tidy(_anchor_rows(length, core)), _ROWS), "anchors")
    found = []
    for grain in (*grains, None):
        classes = stored(rows.groupBy("key", "seg1", "seg2").agg(F.sum("rows").alias("n"), F.min(F.struct("doc", "at", "least", "most")).alias("x")), "classes")
        several = stored(classes.filter("n > 1").select("key", "seg1", "seg2"), "several")
        found.append(stored(rows.join(several, ["key", "seg1", "seg2"], "left_semi").select("doc", (F.col("at") - F.col("most")).alias("s"),
            (F.col("at") + F.col("reach") - F.col("least") + length).alias("e")), "spans"))
        drop_stored(rows, several)
        if grain is None and grains[-1] == 1:
            break
        heads = stored(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"), "heads")
        met = stored(classes.select("key", "x.*").join(heads, "key"), "met")
        drop_stored(classes, heads)
        some = met if grain is None else met.filter(F.col("classes") <= group)
        parts = _with_text(docs, some.select("doc", "key", "at", "least", "most")).mapInArrow(tidy(_segments(length)),
            "key long, doc long, at long, least int, most int, raw binary")
        found.append(stored(parts.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(tidy(_decide(length)),
            _SPANS), "spans"))
        hot = met.filter(F.col("classes") > group)
        if grain is None or not hot.limit(1).count():
            break
        rows = stored(_with_text(docs, hot.select("doc", "key", "at", "least", "most")).mapInArrow(tidy(_refined(length, core, grain)), _ROWS), "anchors")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _passage_rows(window: int, core: int):
    """(key, doc, at): of each `window` words the least-hashed `core` words in a row, by the place of their first word."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(batch.column(1)):
                start, end, first = words(data, off)
                if len(start) < window:
                    continue
                spans = SpanHashes(SpanHashes(data)(start, end), None)
                found = []
                for d in np.flatnonzero(np.diff(first) >= window).tolist():
                    a, n = int(first[d]), int(first[d + 1] - first[d])
                    for s in range(0, n - window + 1, _PLACES - window):
                        at, _, _ = anchors(min(n - s, _PLACES - 1), window, core, spans, a + s)
                        found.append((at + a + s, np.full(len(at), i + d), at + s))
                if found:
                    place, doc, at = map(np.concatenate, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(spans(place, place + core).view(np.int64)), pa.array(ids[doc]), pa.array(at)],
                        ["key", "doc", "at"])

    return run


def shared_passages(docs: DataFrame, window: int = WINDOW_WORDS, core: int = CORE_WORDS) -> DataFrame:
    """(doc, at): places of runs of `core` words that another document holds too; docs: doc, text.

    A passage of `window` words or more that two documents share has such a run in both; none is of fewer than `core` words.
    """
    rows = stored(docs.mapInArrow(tidy(_passage_rows(window, core)), "key long, doc long, at long"), "passages")
    several = stored(rows.groupBy("key").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).filter("x <> y").select("key"), "several")
    out = stored(rows.join(several, "key", "left_semi").select("doc", "at"), "met")
    drop_stored(rows, several)
    return out


def _cover(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def dedup(docs: DataFrame, length: int = LENGTH, core: int = CORE, group: int = GROUP, window: int = WINDOW_WORDS, core_words: int = CORE_WORDS) -> DataFrame:
    """One row of SCHEMA and `kept` (the remaining bytes) per row of docs (doc_id, text).

    n_passage_words: words of the input in runs of core_words or more that another document holds too (see shared_passages);
    it reports passages that are too short to be removed, and does not change what is removed.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    own = docs.select("doc_id", "text", (F.xxhash64("doc_id", "text") if shared else F.col("doc_id").cast("long")).alias("doc"))
    spans = repeated_spans(own.select("doc", "text"), length, core, group).select("doc", "s", "e", F.lit(False).alias("words"))
    passages = shared_passages(own.select("doc", "text"), window, core_words).select("doc", F.col("at").alias("s"),
        (F.col("at") + core_words).alias("e"), F.lit(True).alias("words"))
    lists = spans.unionByName(passages).groupBy("doc").agg(F.collect_list(F.struct("s", "e", "words")).alias("x"))
    joined = own.join(lists, "doc", "left").select("doc_id", "text", "x")

    def run(batches):
        for batch in batches:
            lists, (starts, ends, of_words) = _listed(batch.column(2), ("s", "e", "words"))
            for i, j, data, off in text_slices(batch.column(1)):
                owner = np.repeat(np.arange(i, j), np.diff(lists[i : j + 1]))
                here = slice(lists[i], lists[j])
                lead, word = off[owner - i], of_words[here].astype(bool)
                gone = _cover((lead + starts[here])[~word], (lead + ends[here])[~word], len(data))
                n_removed = per_document(gone.astype(np.int64), off)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[off[:-1][off[:-1] < len(data)]] = gone[off[:-1][off[:-1] < len(data)]]
                left = data[~gone]
                kept_off = off - np.concatenate([[0], np.cumsum(n_removed)])
                raw = memoryview(left.tobytes())
                digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
                passage = np.zeros(j - i, np.int64)
                if word.any():
                    _, _, first = words(data, off)
                    lead = first[owner[word] - i]
                    passage = per_document(_cover(lead + starts[here][word], lead + ends[here][word], int(first[-1])).astype(np.int64), first)
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.array(kept_off, pa.int32()).buffers()[1], pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(n_removed),
                    pa.array(per_document(begin.astype(np.int64), off)), pa.array(digest), pa.array(passage), kept],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"],
                )

    return joined.mapInArrow(tidy(run), SCHEMA + ", kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
