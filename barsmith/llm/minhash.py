"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each document's set of word shingles gets COORDINATES minimum hashes. Documents
   with equal sets form one class, represented by its smallest id.
2. Every (coordinate, value) of a class is an entry; entries met once can join nothing
   and are dropped. A pair at the similarity threshold shares at least `matches` entries
   but for a chance of 1e-8, so a class with fewer shared entries is skipped, and each other
   class is posted only under its rarest entries, all but matches - 1 of those it shares.
3. Within a posting list collisions of whole signatures are counted and pairs with
   `matches` or more are candidates. A list above STAR members is cut into
   chunks whose members are held against the member closest to the chunk's most
   common values, and those centres against each other; members that
   are still in different components after confirmation are then compared
   in blocks, on their full sets, and each block returns only a star per component
   found there; so no link between components is lost and groups of near copies do not
   make all their pairs. Very large lists are first split by a second shared entry.
4. Candidates are confirmed on the full shingle sets; components of confirmed links follow.

Null and wordless texts have the empty set and link with nothing. Repeated ids with different
texts are one node. Rows with a null id have no component and are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SpanHashes, drop_stored, gathered, least_labels, mix, partitions, stored, table, text_slices, tidy, words
from .components import components

COORDINATES = 40
MISSED = 1e-8
STAR, CHUNK = 48, 400
#: Lists of more chunks than this are split by a second entry before members are compared.
REFINE = 25
#: 64-bit words of the filter of ids (4 MB).
FILTER_WORDS = 1 << 19
#: So many ids at most are broadcast (some 16 MB).
BROADCAST_IDS = 1_000_000


def matches_needed(similarity: float, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The most matching coordinates that a pair at `similarity` reaches but for a chance of `missed`."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > missed:
            return max(k, 1)
    return coordinates


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(different shingle hashes, document of each, ascending); shorter texts are one shingle of all their words."""
    low = LOWER[data]
    start, end, first = words(low, off)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    h = SpanHashes(low)(start, end)
    prime = np.uint64(0x100000001B3)

    def run(at: np.ndarray, length: int) -> np.ndarray:
        out = h[at].copy()
        for k in range(1, length):
            out = out * prime + h[at + k]
        return mix(out + np.uint64(length))

    whole = np.flatnonzero(np.arange(len(h)) + width <= first[doc + 1]) if len(h) else np.zeros(0, np.int64)
    got, owner = [run(whole, width)], [doc[whole]]
    for length in range(1, width):
        short = np.flatnonzero(n == length)
        got.append(run(first[short], length))
        owner.append(short)
    s, d = np.concatenate(got), np.concatenate(owner)
    key = mix(s ^ mix(d.astype(np.uint64) + np.uint64(3)))
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    keep = np.sort(order[new])
    s, d = s[keep], d[keep]
    order = np.argsort(d, kind="stable")
    return s[order], d[order]


_MULTIPLY = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, 1257, dtype=np.uint64))


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (of the set), sig (null for the empty set) of each row."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(1)):
                s, d = shingles(data, off, width)
                n = np.bincount(d, minlength=j - i)
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                sig, fp = np.zeros((j - i, coordinates), np.int32), np.zeros((2, j - i), np.uint64)
                if len(full):
                    for k in range(coordinates):
                        sig[full, k] = np.minimum.reduceat((s * _MULTIPLY[k] + _ADD[k]) >> np.uint64(33), begin).astype(np.int32)
                    fp[0, full] = np.add.reduceat(mix(s + np.uint64(17)), begin)
                    fp[1, full] = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * coordinates, pa.int32()), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(pa.array(x.view(np.int64)) for x in fp), lists],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>")


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """kv, f (classes with that entry), rep, shared (the class's entries met twice or more) for each posted entry."""
    entries = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long")).alias("kv"))
    often = stored(entries.groupBy("kv").agg(F.count(F.lit(1)).alias("f")).filter("f >= 2"), "entries")
    by_rep = entries.join(often, "kv").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "kv"))).alias("e")).filter(F.size("e") >= matches)
    posted = F.slice("e", F.lit(1), F.size("e") - (matches - 1))
    out = by_rep.select("rep", F.transform("e", lambda x: x["kv"]).alias("shared"), F.explode(posted).alias("p"))
    out = stored(out.select(F.col("p.kv").alias("kv"), F.col("p.f").alias("f"), "rep", "shared"), "postings")
    drop_stored(often)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a list column of entries: values by coordinate, and negative numbers that match nothing."""
    n = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    kv = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    width = int(kv.max(initial=0) >> 32) + 1
    out = -1 - np.repeat(np.arange(n), width).reshape(n, width)
    out[row, kv >> 32] = kv & 0xFFFFFFFF
    return out


def _grouped(batches):
    """(key values, table of rows) for each run of equal (kv, salt): rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        kv, salt = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero((kv[1:] != kv[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(kv)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = (int(kv[a]), int(salt[a]))
            if now != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _counted(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    return sum((sig[:, c][:, None] == other[:, c][None, :]).astype(np.int16) for c in range(sig.shape[1]))


PAIRS = "u long, v long, kv long, centre boolean"


def _merge(matches: int, star: int):
    """Candidates of each chunk of a posting list; of a chunk of a large list also its centre."""

    def run(batches):
        u, v, lists, centres = [], [], [], []

        def flush():
            nonlocal u, v, lists, centres
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, lists, centres)], ["u", "v", "kv", "centre"])
            u, v, lists, centres = [], [], [], []
            return out

        for (kv, _), rows in _grouped(batches):
            rep, large = rows["rep"].to_numpy(), rows["f"][0].as_py() > star
            sig = _matrix(rows["shared"].chunk(0))
            if large:
                common = np.array([np.bincount(np.unique(col, return_inverse=True)[1]).argmax() for col in sig.T])
                values = np.array([np.unique(col)[k] for col, k in zip(sig.T, common, strict=True)])
                near = (sig == values).sum(1)
                c = int(np.lexsort((rep, -near))[0])
                j = np.flatnonzero((sig == sig[c]).sum(1) >= matches)
                j = j[j != c]
                u += [np.full(len(j), rep[c]), rep[c : c + 1]]
                v += [rep[j], rep[c : c + 1]]
                centres += [np.zeros(len(j), bool), np.ones(1, bool)]
                lists.append(np.full(len(j) + 1, kv))
            elif len(rep) > 1:
                i, j = np.nonzero(np.triu(_counted(sig, sig) >= matches, 1))
                u.append(rep[i])
                v.append(rep[j])
                lists.append(np.full(len(i), kv))
                centres.append(np.zeros(len(i), bool))
            if sum(map(len, u)) > 20_000:
                yield flush()
        if u:
            yield flush()

    return run


def _common_sizes(sets: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of left's and right's sets, from products of 0/1 matrices a slice of columns at a time."""
    offsets = sets.offsets.to_numpy()
    begin, size = offsets[:-1], np.diff(offsets)
    values = sets.values.to_numpy()
    flat = [gathered(values, begin[x], size[x]) for x in (left, right)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    row, at = [], []
    for x, f in zip((left, right), flat, strict=True):
        k = np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0))
        hit = both[k] == f if len(both) else np.zeros(len(f), bool)
        row.append(np.repeat(np.arange(len(x)), size[x])[hit])
        at.append(k[hit])
    for c in range(0, len(both), 8192):
        matrices = []
        for x, r, k in zip((left, right), row, at, strict=True):
            m = np.zeros((len(x), min(8192, len(both) - c)), np.float32)
            some = (k >= c) & (k < c + 8192)
            m[r[some], k[some] - c] = 1
            matrices.append(m)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


def _across(matches: int, percent: int):
    """Confirmed links between components in each block pair (kv, salt) of a large list, as stars: (member, least of its tile component)."""

    def run(batches):
        for (kv, _), rows in _grouped(batches):
            rep, comp, block = (rows[c].to_numpy() for c in ("rep", "comp", "block"))
            sig, sets = _matrix(rows["shared"].chunk(0)), rows["shingles"].chunk(0)
            n = np.diff(sets.offsets.to_numpy())
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(rep))
            label = np.arange(len(rep))
            left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            for k in range(0, len(left), 256):
                part = left[k : k + 256]
                may = (_counted(sig[part], sig[right]) >= matches) & (comp[part][:, None] != comp[right][None, :])
                part, may = part[may.any(1)], may[may.any(1)]
                if not len(part):
                    continue
                other, may = right[may.any(0)], may[:, may.any(0)]
                common = _common_sizes(sets, part, other)
                i, j = np.nonzero(may & (100 * common >= percent * (n[part][:, None] + n[other][None, :] - common)))
                if len(i):
                    label = label[least_labels(len(rep), label[place[part[i]]], label[place[other[j]]])[label]]
            some = np.flatnonzero(label != np.arange(len(rep)))
            if len(some):
                u, v = rep[order[some]], rep[order[label[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), kv)), pa.array(np.zeros(len(u), bool))],
                    ["u", "v", "kv", "centre"])

    return run


def _sorted_lists(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "kv", "salt").sortWithinPartitions("kv", "salt")


def _pairs(raw: DataFrame) -> DataFrame:
    return raw.filter("NOT centre AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _words_and_masks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    one = np.uint64(1)
    return (h % np.uint64(FILTER_WORDS)).astype(np.int64), one << (h >> np.uint64(40) & np.uint64(63)) | one << (h >> np.uint64(50) & np.uint64(63))


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """FILTER_WORDS 64-bit words of a Bloom filter of ids (doc_id, different), or None if they would fill it; its size does not grow with them."""
    if ids.count() > 4 * FILTER_WORDS:
        return None

    def run(batches):
        for batch in batches:
            word, mask = _words_and_masks(batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    rows = ids.select("doc_id").mapInArrow(tidy(run), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[rows.word.to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def shingle_sets(docs: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (their hashes) of the rows of docs whose id is in ids (doc_id, different), and of a few others.

    Where a filter of the ids fits its bound, nothing is shuffled for this; the others are those it lets pass, and
    joins on the ids leave them out.
    """
    words_of = id_filter(ids)
    passed = docs.sparkSession.sparkContext.broadcast(words_of)
    if words_of is None:
        docs = docs.join(ids, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            if passed.value is not None:
                word, mask = _words_and_masks(column.fill_null(0).to_numpy(zero_copy_only=False))
                may = (passed.value[word] & mask == mask) & column.is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(may))
            for i, j, data, off in text_slices(batch.column(1)):
                s, d = shingles(data, off, width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=j - i))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with 100 * intersection >= percent * union of any of their rows' sets (doc_id, shingles)."""
    pairs = stored(pairs, "pairs")
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    out = stored(both.filter(F.col("common") * 100 >= F.lit(percent) * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v").distinct(), "links")
    drop_stored(pairs)
    return out


def _refined(rows: DataFrame, matches: int, chunk: int) -> DataFrame:
    """rows (kv, f, rep, shared, comp) with lists of more than REFINE chunks split by a second entry.

    Two members that share `matches` entries share matches - 1 besides the list's own, so each is posted under its
    rarest others, all but matches - 2 of them: the rarest that both have is among those of either. Comparing blocks of a
    list takes rows in the square of its members, this some entries for each.
    """
    if matches < 2:
        return rows
    c = F.col
    big = c("f") > REFINE * chunk
    others = F.filter("shared", lambda e: e != c("kv"))
    posted = F.slice(others, F.lit(1), F.greatest(F.size(others) - (matches - 2), F.lit(0)))
    sub = rows.filter(big).select("rep", "shared", "comp", "kv", F.explode(posted).alias("e")).select(F.xxhash64("kv", "e").alias("kv"), "rep",
        "shared", "comp")
    met = sub.groupBy("kv").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("kv", "f")
    return rows.filter(~big).unionByName(sub.join(met, "kv"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, star: int = STAR, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    matches = matches_needed(percent / 100, coordinates)
    sets = stored(signatures(docs, width, coordinates), "signatures")
    named = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select("n_shingles", "fp1", "fp2",
        F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig")), "classes")
    posted = postings(classes.select("rep", "sig"), matches)
    chunks = F.when(F.col("f") > star, F.ceil(F.col("f") / chunk)).otherwise(1)
    salt = F.pmod(F.xxhash64("rep"), chunks).cast("long")
    first = stored(_sorted_lists(posted.select("kv", salt.alias("salt"), "f", "rep", "shared")).mapInArrow(tidy(_merge(matches, star)), PAIRS), "first")
    centres = first.filter("centre").select("kv", F.col("u").alias("rep")).join(posted.filter(F.col("f") > chunk).select("kv", "rep", "f", "shared"),
        ["kv", "rep"])
    second = _sorted_lists(centres.select("kv", F.lit(0).cast("long").alias("salt"), "f", "rep", "shared")).mapInArrow(tidy(_merge(matches, star)), PAIRS)
    ids = stored(posted.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets_of = stored(shingle_sets(docs, width, ids), "sets")
    links = confirmed(_pairs(first.unionByName(second)), sets_of, percent)
    scratch = [classes, posted, first, ids, sets_of, links]

    large = posted.filter(F.col("f") > star)
    if large.limit(1).count():
        so_far = stored(components(links), "components")
        known = large.join(so_far, F.col("node") == F.col("rep"), "left").select("kv", "f", "rep", "shared", F.coalesce("component", "rep").alias("comp"))
        known = stored(known, "known")
        split = stored(known.groupBy("kv").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("kv"), "split")
        rows = stored(known.join(split, "kv", "left_semi"), "rows")
        scratch += [so_far, known, split, rows]
        rows = _refined(rows, matches, chunk)
        rows = rows.join(sets_of, F.col("rep") == F.col("doc_id")).withColumn("blocks", F.ceil(F.col("f") / chunk)).withColumn("block",
            F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("kv", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("salt"), "rep", "comp", "block",
            "shared", "shingles")
        more = _sorted_lists(rows).mapInArrow(tidy(_across(matches, percent)), PAIRS).select("u", "v").distinct()
        more = stored(more, "links")
        scratch.append(more)
        links = links.unionByName(more)

    comps = components(links)
    labels = classes.join(comps, F.col("node") == F.col("rep"), "left").select("n_shingles", "fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    labels = stored(labels, "labels")
    out = sets.select("doc_id", "n_shingles", "fp1", "fp2").join(labels, ["n_shingles", "fp1", "fp2"], "left")
    component = F.coalesce("component", "doc_id")
    own = F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(own, component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    drop_stored(comps, *scratch)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents whose component has a smaller id; all rows of a kept id stay, and those without an id.

    The ids to go are broadcast if there are at most BROADCAST_IDS of them, else joined by a shuffle.
    """
    gone = stored(near_duplicates(docs, width, percent).filter("NOT kept").select("doc_id").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_minhash_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <>
    b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p WHERE 100 * c >= 85 * (n + m - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.j, r.root FROM r JOIN l ON l.i = r.node),
k AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, coalesce(len(s.sh), 0)::BIGINT AS n_shingles, k.component_id, s.doc_id = k.component_id AS kept FROM s JOIN k ON k.node = s.doc_id"""
