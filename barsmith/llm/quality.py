"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over BUCKETS hashed unigrams and bigrams of lower-cased words:
one counted over trusted documents, one over every document. The target is smoothed towards the
corpus: SMOOTHING pseudo-counts of each n-gram, so that p_target / p_raw = (count + s) / (expected + s), where
the target is expected to hold `expected` of it were it drawn from the corpus. Rare n-grams are near 1
whatever the size of corpus and target, so small tables are judged like large ones. A document's score is
the mean of log(p_target / p_raw) over its own n-grams, so length does not matter, and every document is
kept or rejected by the same fixed threshold.

Hashing merges n-grams, so the ratio is that of coarser features: over target documents its mean can
only be smaller than without hashing (the divergence of merged outcomes is never larger), which errs towards
keeping less extreme scores. The table of ratios has BUCKETS numbers however large the corpus is.

Labels are split by a hash of the id: one half of the good ones fits the target (at most TRUSTED rows), the
other half never does; THRESHOLD was chosen, and is tested, on that half.

Null or wordless texts have no n-grams: their score is null and they fail the
base rules. With no trusted documents every score is 0 and only base rules reject. Rows with a null
id are judged, never trusted; repeated ids are judged row by row; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SpanHashes, mix, per_document, table, text_slices, tidy, words

BUCKETS = 1 << 17
#: At most so many trusted rows (those of least hash) fit the target; the raw counts use every document.
TRUSTED = 20_000
#: From 200 to 51 282 documents every held-out good document scored above -0.225, and 90 to 99 % of the bad ones below this.
THRESHOLD = -0.24
#: Pseudo-counts of each n-gram in the target, spread as in the corpus: n-grams of which the target should hold few say little.
SMOOTHING = 2.0
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def ngram_buckets(hashes: np.ndarray, first: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each word and of each pair of neighbours in a document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = mix(hashes[pair] * np.uint64(3) + hashes[pair + 1])
    mask = np.uint64(buckets - 1)
    return np.concatenate([hashes & mask, both & mask]).astype(np.int64), np.concatenate([doc, doc[pair]])


def _counter(trusted: np.ndarray, buckets: int):
    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column(0)
            good = np.isin(ids.fill_null(0).to_numpy(), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for i, j, data, off in text_slices(batch.column(1)):
                start, end, first = words(data, off)
                bucket, doc = ngram_buckets(SpanHashes(LOWER[data])(start, end), first, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                if good[i:j].any():
                    target += np.bincount(bucket[good[i:j][doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 20_000):
            part = at[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], ["bucket", "raw", "target"])

    return count


def log_ratios(docs: DataFrame, trusted: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, drawn to 0 where the target is expected to hold few: log((count + s) / (expected + s)); `buckets`
    numbers however many documents there are."""
    counts = docs.select("doc_id", "text").mapInArrow(tidy(_counter(trusted, buckets)), "bucket long, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a label is kept from the target."""
    return F.pmod(F.xxhash64(doc_id, F.lit("held out")), F.lit(2)) == 1


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> np.ndarray:
    """Ids labelled good and never bad, of those not held out at most `limit`, chosen by hash."""
    good = labels.filter("doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    rows = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    return np.sort(rows.doc_id.to_numpy(np.int64))


def base_statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per document of a slice: the counts of the base rules."""
    start, end, first = words(data, off)
    spans = SpanHashes(data)
    n_words = np.diff(first)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    doc = np.repeat(np.arange(len(off) - 1), n_words)

    # \n-split lines that hold a word, told apart by (document, content)
    feeds = np.flatnonzero(data == 10)
    at = np.unique(np.concatenate([off[:-1], feeds + 1]))
    at = at[at < len(data)]
    owner = np.searchsorted(off, at, "right") - 1
    stop = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, at)], off[owner + 1])
    has = np.searchsorted(start, stop) > np.searchsorted(start, at)
    at, stop, owner = at[has], stop[has], owner[has]
    keys = mix(spans(at, stop) + mix(owner.astype(np.uint64) + np.uint64(7)))
    _, seen = np.unique(keys, return_index=True)
    lines = np.bincount(owner, minlength=len(off) - 1) - np.bincount(owner[seen], minlength=len(off) - 1)

    # words inside five-word windows that occur twice or more in their document
    repeats = np.zeros(len(start), np.int64)
    if len(start) >= 5:
        h = spans(start, end)
        win = h[:-4].copy()
        for k in range(1, 5):
            win = win * np.uint64(0x100000001B3) + h[k : len(h) - 4 + k]
        whole = np.flatnonzero(doc[:-4] == doc[4:])
        win = mix(win[whole] + mix(doc[whole].astype(np.uint64) + np.uint64(11)))
        ordered = np.sort(win)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            found = whole[np.isin(win, twice)]
            edge = np.zeros(len(start) + 6, np.int64)
            np.add.at(edge, found, 1)
            np.add.at(edge, found + 5, -1)
            repeats = (np.cumsum(edge)[: len(start)] > 0).astype(np.int64)
    return {
        "n_words": n_words,
        "word_chars": per_document(lead[end] - lead[start], first),
        "n_symbols": per_document(symbol[data], off),
        "n_dup_lines": lines,
        "n_repeat_words": per_document(repeats, first),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """One row of SCHEMA per row of docs (doc_id, text); repeated ids are judged row by row."""
    spark = docs.sparkSession
    ratios = spark.sparkContext.broadcast(log_ratios(docs, trusted_ids(labels, trusted), buckets))

    def score(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in text_slices(batch.column(1)):
                out = base_statistics(data, off)
                start, end, first = words(data, off)
                bucket, doc = ngram_buckets(SpanHashes(LOWER[data])(start, end), first, buckets)
                grams = np.bincount(doc, minlength=j - i)
                llr = np.bincount(doc, ratios.value[bucket], j - i) / np.maximum(grams, 1)
                failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in out.values()), pa.array(llr, mask=grams == 0), pa.array(failed),
                    pa.array(~failed & (llr >= threshold))],
                    ["doc_id", *out, "llr", "base_failed", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(score), SCHEMA)


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
