"""The pipeline against each stage's decision recomputed from the stage before it, and on odd and empty tables."""

from collections import Counter

import public_tokenizers

import corpus_pipeline as cp
from barsmith.llm import pieces, quality, secrets
from tests.llm.test_mixing import by_hand
from tests.llm.test_operators import WORD, brute_components
from tests.llm.test_secrets import by_library

SF = "/root/testdata/sf0.001"
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = texts_of(docs)
    one = cp.quality_rules(spark, docs, SF)
    kept = texts_of(one)
    # base rules by hand; the ratio, tested against unhashed counts elsewhere, decides among those that pass
    passed = set()
    for i, t in before.items():
        w = [x.decode() for x in WORD.findall(t.encode())]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + x for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for x in range(5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w):
            passed.add(i)
    ratio = {r.doc_id: r.llr for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert one.columns == docs.columns and set(kept) == {i for i in passed if ratio[i] >= quality.THRESHOLD} and len(kept) < len(passed) < len(before)
    assert all(before[i] == t for i, t in kept.items())

    two = cp.near_dedup(spark, one, SF)
    ids = sorted(kept)
    expected = {i for i, (_, c) in zip(ids, brute_components([kept[i] for i in ids], 5, 80), strict=True) if ids[c] == i}
    assert set(texts_of(two)) == expected and len(expected) < len(ids)

    three = cp.secret_scan(spark, two, SF)
    masked = texts_of(three)
    for i in expected:
        parts, done = [], 0
        for s, e in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in by_library(kept[i])):
            if s >= done:
                parts += [kept[i][done:s], secrets.MASK.decode()]
            done = max(done, e)
        assert masked[i] == "".join([*parts, kept[i][done:]])
    assert all(r.n_chars == len(r.text) for r in three.collect()) and masked.keys() == expected

    four = cp.source_mix(spark, three, SF)
    mixed = [(r.doc_id, r.text) for r in four.collect()]
    hand = by_hand([(r.doc_id, r.text, r.source) for r in three.collect()])
    assert four.columns == docs.columns and Counter(i for i, _ in mixed) == Counter({i: len(x[3]) for i, x in hand.items() if x[3]})
    time = {i: x[3][0][0] if x[3][0][1] == 0 else None for i, x in hand.items() if x[3]}  # sources without a slope: time is the share
    flat = [time[i] for k, (i, _) in enumerate(mixed) if time[i] is not None and i not in {j for j, _ in mixed[:k]}]
    assert flat == sorted(flat) and all(masked[i] == t for i, t in mixed)

    five = cp.piece_encoding(spark, four, SF).collect()
    model = pieces.Pieces(MODEL)
    assert sorted((r.doc_id, model.decode(r.ids)) for r in five) == sorted(mixed) and all(r.decodes for r in five)


def test_run_is_the_stages_in_a_row(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_crc32", "decodes", "ids"] and got.count() > 100 and got.filter("NOT decodes").count() == 0
    assert [name for name, _ in cp.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "source mixing", "SentencePiece encoding"]
    again = cp.run(spark, SF)
    key = lambda r: (r.doc_id, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, again.collect()))


def test_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    words = " ".join(f"word{k} thing{k % 7}" for k in range(30))
    rows = [(1, words, "en", "a", 5, "x"), (1, words, "en", "a", 5, "x"), (2, words + " end", "en", None, 5, "x"), (3, None, None, None, None, None),
        (4, "", "en", "a", 0, "x"), (None, words + " null id", "en", "a", 5, "x"), (5, words[::-1] + " token=abcdef123", "en", "b", 5, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        last = cp.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count() and last.filter("NOT decodes").count() == 0
        assert docs.filter("text LIKE '%abcdef123%'").count() == 0
