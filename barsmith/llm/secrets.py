"""Secret scans: all rules in one minimal automaton, one pass over the bytes.

The pass marks each byte with the rules of which a match may end there. Where a run
of marks of a rule ends, its expression reversed is followed back to the leftmost start behind
the rule's last match, and forwards from there; so spans are the leftmost, longest,
non-overlapping ones. Those below the rule's least length are then dropped.

Null and empty texts have no spans; rows are judged one by one, equal ones alike; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import table, text_slices, tidy

#: Kind, expression, either case, least length, least length of its last part ("+"). The first BASE are the contract's.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 0, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20, 1),
    ("hex", r"[0-9a-f]+", False, 24, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15, 1),
    ("google", r"AIza[0-9A-Za-z_-]+", False, 39, 1),
    ("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]+", False, 24, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 36, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 27, 1),
]
BASE = 3
#: Letters and digits make short hex runs all over; a whole run is one match, so short ones can be passed over at once.
_SHORTEST = {k: least for k, (kind, _, _, least, _) in enumerate(RULES) if kind == "hex"}


@functools.cache
def compiled() -> Automaton:
    """The rules' automaton: a few MB, whatever the documents."""
    return Automaton([(pattern, fold) for _, pattern, fold, _, _ in RULES])


def byte_spans(data: np.ndarray, off: np.ndarray, automaton: Automaton) -> list[tuple[int, int, int]]:
    """(start, end, rule) over a slice, in order of start then rule."""
    return [(s, e, r) for s, e, r, tail in automaton.spans(data, off, _SHORTEST) if e - s >= RULES[r][3] and tail >= RULES[r][4]]


def spans_by_document(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(first row, spans of each document relative to it in bytes, bytes, offsets) of each slice."""
    for i, j, data, off in text_slices(column):
        found: list[list] = [[] for _ in range(j - i)]
        spans = byte_spans(data, off, automaton)
        owner = np.searchsorted(off, [s for s, _, _ in spans], "right") - 1
        for d, (s, e, rule) in zip(owner, spans, strict=True):
            found[d].append((s - int(off[d]), e - int(off[d]), rule))
        yield i, found, data, off


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans, their digest, all spans (code points, end exclusive)."""
    machine = docs.sparkSession.sparkContext.broadcast(compiled())

    def run(batches):
        for batch in batches:
            for i, found, data, off in spans_by_document(batch.column(1), machine.value):
                counts = np.zeros((BASE, len(found)), np.int64)
                said, digest = [], []
                for d, spans in enumerate(found):
                    parts = []
                    if spans:
                        lead = np.concatenate([[0], np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80)])
                        parts = [(rule, f"{RULES[rule][0]}:{lead[s]}:{lead[e]}") for s, e, rule in spans]
                        for rule, _ in parts:
                            if rule < BASE:
                                counts[rule, d] += 1
                    said.append(",".join(x for _, x in parts))
                    digest.append(hashlib.sha256(",".join(x for r, x in parts if r < BASE).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(found)), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(said, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = b"[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span (overlaps united) of its text replaced by MASK; other columns as they are, n_chars recounted."""
    machine = docs.sparkSession.sparkContext.broadcast(compiled())
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts: list = batch.column(at).to_pylist()
            for i, found, data, off in spans_by_document(batch.column(at), machine.value):
                for d, spans in enumerate(found):
                    if not spans:
                        continue
                    raw, out, done = data[off[d] : off[d + 1]].tobytes(), [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            out += [raw[done:s], MASK]
                        done = max(done, e)
                    texts[i + d] = b"".join([*out, raw[done:]]).decode()
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
