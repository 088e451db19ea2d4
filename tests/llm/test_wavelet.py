"""Wavelet shards against the tokenizers library and plain arrays."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from barsmith.llm import wavelet
from barsmith.llm.common import text_slices
from barsmith.llm.vocabulary import HashIndex
from tests.llm.test_operators import EDGE

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hash_index_is_a_dictionary():
    rng = np.random.default_rng(4)
    index, numbers = HashIndex(2), {}
    for _ in range(20):
        keys = rng.integers(0, 3000, 200).astype(np.uint64)
        assert index.find(keys).tolist() == [numbers.get(k, -1) for k in keys.tolist()]
        new = np.array([k for k in np.unique(keys).tolist() if k not in numbers], np.uint64)
        numbers |= {k: len(numbers) + i for i, k in enumerate(new.tolist())}
        index.add(new)


@pytest.mark.parametrize("high", [50, 70_000, 200_000])
def test_matrix(high):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, high, 3000), np.arange(high)]).astype(np.uint32)[:140_000]
    ids, sizes, w = wavelet.unpack(wavelet.pack([7, None], np.array([1000, len(x) - 1000]), x))
    assert ids == [7, None] and sizes.tolist() == [1000, len(x) - 1000] and (w.decode() == x).all()
    for i in (0, 511, 512, 2999):
        assert w.access(i) == x[i] and w.rank(int(x[i]), i) == int((x[:i] == x[i]).sum())
    assert w.occurrences(9) == np.flatnonzero(x == 9).tolist() and w.count(high + 5) == 0
    with pytest.raises(IndexError):
        w.select(9, w.count(9))


def test_matrix_of_one_id_and_of_none():
    assert (wavelet.unpack(wavelet.pack([1], np.array([1]), np.array([1], np.uint16)))[2].decode() == [1]).all()
    assert len(wavelet.unpack(wavelet.pack([], np.array([]), np.zeros(0, np.uint16)))[2].decode()) == 0


def test_every_two_byte_character_in_context():
    """Ids of runs in a row are those of the whole text, for each character beside letters, digits and punctuation."""
    encoder = wavelet.ShardEncoder(PATH)
    rng = random.Random(5)
    mixed = "abz AZ019!.,'<>|-_\n\t éÉßİıŁ×÷ΣσЖäöǘ½²ªº文か한​İ=s t re ll"
    texts = ["".join(rng.choice(mixed) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    some = [*range(1, 0x800), *range(0x800, 0xD800, 97), 0x1F600]
    texts += [x + chr(c) + y for c in some for x in ("a", "7", "!", "") for y in ("a", "7", "=", "s", "")]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for i, j, data, off in text_slices(pa.array(texts)):
        ids, n = encoder(data, off)
        ends = np.cumsum(n)
        assert [ids[e - c : e].tolist() for c, e in zip(n.tolist(), ends.tolist(), strict=True)] == want[i:j]


def test_a_full_cache_starts_afresh():
    encoder = wavelet.ShardEncoder(PATH)
    encoder.codes.limit = 1
    for _ in range(2):
        for _, _, data, off in text_slices(pa.array(["some words", "more words 12"]), 1):
            assert encoder(data, off)[0].tolist() == encoder.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids


def test_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    odd = ["don't I'm 12a3,x! <|endoftext|> İstanbul a÷b 漢字 é́ _x_ \x1c", "naïve—no… Ça", "İ=", "long " * 5000]
    texts = [*EDGE, *odd]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (3, "two"), (None, "null id")]
    path = str(tmp_path / "w")
    wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, path, shard_tokens=50)
    got = sorted(wavelet.read_shards(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x.ids + [wavelet.END_ID] for x in Tokenizer.from_file(PATH).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert [r.doc_id for r in got] == [i for i, _ in rows] and len({r.shard for r in got}) > 3
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_shards_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert wavelet.read_shards(spark, path).count() == 0
