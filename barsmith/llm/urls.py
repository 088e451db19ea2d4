"""URL filters: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

Host and path come from built-in string functions. A rule decides the url it
fits; every other url is blocked by one strict term, or by different soft terms that together
weigh SOFT_LIMIT or more (no soft term does alone). Terms count where the bytes beside them are not
ASCII letters or digits, in any part of the url, letters in either case; a term met often counts once.

Null and empty urls have empty host and path, no terms, and are allowed. Rows are judged one by one, repeated
ids and equal rows each on its own; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table, text_slices, tidy

#: Fixed values: (verdict, host, path) rules; (term, weight), weight 0: strict.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
VOCABULARY = [
    ("adult", 0), ("casino", 0), ("escort", 0), ("hentai", 0), ("keygen", 0), ("malware", 0), ("porn", 0), ("sexcam", 0), ("viagra", 0), ("warez", 0),
    ("xxx", 0),
    ("ad", 1), ("ads", 1), ("banner", 1), ("bonus", 1), ("cam", 1), ("cheap", 1), ("click", 1), ("coupon", 1), ("deal", 1), ("free", 1), ("hot", 1),
    ("popup", 1), ("sponsored", 1), ("track", 1), ("tracker", 1), ("win", 1),
    ("bet", 2), ("betting", 2), ("crack", 2), ("dating", 2), ("jackpot", 2), ("loan", 2), ("nude", 2), ("payday", 2), ("pills", 2), ("poker", 2),
    ("sex", 2), ("slots", 2), ("torrent", 2),
]
SOFT_LIMIT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = np.isin(np.arange(256), np.frombuffer(b"0123456789" + _LOWER.encode(), np.uint8))


@functools.lru_cache(maxsize=4)
def automaton(vocabulary: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """One per vocabulary and worker process; values are the terms' numbers."""
    machine = ahocorasick.Automaton()
    for k, (term, _) in enumerate(vocabulary):
        if not term or not term.isascii() or term != term.lower():
            raise ValueError(f"terms are ASCII in lower case: {term!r}")
        machine.add_word(term, k)
    machine.make_automaton()
    return machine


def counted(data: np.ndarray, off: np.ndarray, vocabulary: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(different strict terms, weight of the different soft terms) of each url of a slice, all urls in one pass."""
    n = len(off) - 1
    low = LOWER[data]
    hits = np.array(list(automaton(vocabulary).iter(low.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
    end, term = hits[:, 0] + 1, hits[:, 1]
    start = end - np.array([len(t) for t, _ in vocabulary], np.int64)[term]
    url = np.searchsorted(off, end - 1, "right") - 1
    inside = start >= off[url]
    letter = np.concatenate([[False], _ALNUM[low], [False]])  # shifted by one place
    alone = inside & ((start == off[url]) | ~letter[start]) & ((end == off[url + 1]) | ~letter[end + 1])
    met = np.unique(url[alone] * len(vocabulary) + term[alone])
    url, weight = met // max(len(vocabulary), 1), np.array([w for _, w in vocabulary], np.int64)[met % max(len(vocabulary), 1)]
    return np.bincount(url[weight == 0], minlength=n), np.bincount(url, weight, n).astype(np.int64)


def judge(pages: DataFrame, vocabulary: list[tuple[str, int]] = VOCABULARY, limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, soft_weight of each row of pages (page_id, url)."""
    terms = tuple(vocabulary)

    def run(batches):
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(1)):
                strict, soft = counted(data, off, terms)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(strict, pa.int64()),
                    pa.array(soft, pa.int64())], ["page_id", "url", "n_strict", "soft_weight"])

    kind = pages.schema["page_id"].dataType.simpleString()
    met = pages.select("page_id", "url").mapInArrow(tidy(run), f"page_id {kind}, url string, n_strict long, soft_weight long")
    cut = F.instr("url", "://")
    rest = F.coalesce(F.when(cut > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    raw_host = F.regexp_extract("rest", "^[^/?#]*", 0)
    parts = met.withColumn("rest", rest).select(
        "page_id", F.translate(raw_host, _UPPER, _LOWER).alias("host"), "n_strict", "soft_weight",
        F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0).alias("path"),
    )
    rule = verdict = None
    for decision, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    bad = (F.col("n_strict") > 0) | (F.col("soft_weight") >= limit)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "n_strict", "soft_weight")


def op9_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle_op9() -> str:
    when_rule = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES,
        key=lambda r: -len(r[1] + r[2])))
    when_verdict = "\n".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    words = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY)
    return f"""
WITH a AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS low,
  CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
t(term, weight) AS (VALUES {words}),
m AS (SELECT DISTINCT low, term, weight FROM b JOIN t ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')),
n AS (SELECT low, count(*) FILTER (weight = 0)::BIGINT AS n_strict, sum(weight)::BIGINT AS soft_weight FROM m GROUP BY low),
c AS (SELECT b.*, coalesce(n_strict, 0) AS n_strict, coalesce(soft_weight, 0) AS soft_weight, CASE {when_rule} END AS rule FROM b LEFT JOIN n USING (low))
SELECT page_id, host, path, rule, CASE {when_verdict} WHEN n_strict > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
    n_strict, soft_weight FROM c"""
