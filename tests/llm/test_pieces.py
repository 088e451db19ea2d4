"""Merge-dropout against an agenda written apart, the sentencepiece library and its own decoding."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from barsmith.llm import pieces
from barsmith.llm.common import SpanHashes, text_slices
from tests.llm.test_operators import EDGE, SF, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
TEXTS = [*[t or "" for t in EDGE], "  a  b ", "日本 語\n\t x", "ünïcode 🎉 " * 3, "unbrokenrunofmanyletters" * 9, "the the the"]
M64 = (1 << 64) - 1


def dropped(key: int, left: int, right: int, rate: float) -> bool:
    h = (key ^ (left * 0x9E3779B97F4A7C15) ^ (right * 0xC2B2AE3D27D4EB4F)) & M64
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & M64
    return ((h ^ (h >> 29)) * 0x94D049BB133111EB & M64) >> 32 < int(rate * 2**32)


def by_hand(sp, run: str, key: int, rate: float) -> list[int]:
    """Look at all neighbours again after each merge; take the best scored, then leftmost, that is not dropped."""
    parts = [(c, i, i + 1) for i, c in enumerate(run.replace(" ", "▁"))]
    while True:
        found = []
        for i in range(len(parts) - 1):
            both = parts[i][0] + parts[i + 1][0]
            k = sp.piece_to_id(both)
            if sp.id_to_piece(k) == both and not sp.is_control(k) and not sp.is_unknown(k) and not dropped(key, parts[i][1], parts[i + 1][2], rate):
                found.append((-sp.get_score(k), i))
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][1], parts[i + 1][2])]
    out = []
    for p, _, _ in parts:
        k = sp.piece_to_id(p)
        out += [k] if sp.id_to_piece(k) == p else [sp.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
    return out


def encoded(encoder, texts, ids):
    out = []
    for i, j, data, off in text_slices(pa.array(texts)):
        got, n, exact = encoder(data, off, ids[i:j])
        assert exact.all()
        ends = np.cumsum(n)
        out += [got[e - c : e].tolist() for c, e in zip(n.tolist(), ends.tolist(), strict=True)]
    return out


def test_without_dropout_as_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    assert encoded(pieces.Encoder(MODEL, dropout=0.0), TEXTS, np.arange(len(TEXTS))) == [sp.encode(t) for t in TEXTS]


@pytest.mark.parametrize("rate", [0.1, 0.6])
def test_dropout_by_hand(rate):
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    encoder = pieces.Encoder(MODEL, dropout=rate)
    doc_ids = np.arange(len(TEXTS)) + 10**15
    want = []
    for t, d in zip(TEXTS, doc_ids, strict=True):
        raw = np.frombuffer((" " + t if t else t).encode(), np.uint8)
        start, end, _ = pieces.runs(raw, np.array([0, len(raw)]))
        keys = pieces.run_keys(SpanHashes(raw)(start, end), np.full(len(start), d), encoder.seed)
        want.append([x for s, e, k in zip(start, end, keys.tolist(), strict=True) for x in by_hand(sp, raw[s:e].tobytes().decode(), k, rate)])
    got = encoded(encoder, TEXTS, doc_ids)
    assert got == want
    assert [encoder.pieces.decode(x) for x in got] == TEXTS
    assert encoded(encoder, TEXTS, doc_ids) == got


def test_each_document_is_cut_in_its_own_way():
    encoder = pieces.Encoder(MODEL)
    copies = encoded(encoder, ["an interesting international conversation about tokenization"] * 200, np.arange(200))
    assert len(set(map(tuple, copies))) > 50


def test_encode(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(1, "one more", "x"), (3, "one", "x"), (None, "null id", None)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    model = pieces.Pieces(MODEL)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, model.decode(r.ids)) for r in got), key=key) == sorted(((i, t or "") for i, t, _ in rows), key=key)
    assert all(r.decodes and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert pieces.encode(empty_docs(spark), PATH).count() == 0


def test_query(spark):
    got = pieces.op10_merge_dropout(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and got.filter("NOT decodes").count() == 0
