"""Training-corpus pipeline: quality rules, near-dedup, secret redaction, curriculum mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barsmith.llm import minhash, mixing, pieces, quality, secrets
from barsmith.llm.common import scratch_scope, shared_dir, stored, table
from barsmith.sources import files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; an id is kept if each of its rows is."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    rejected = stored(judged.filter("NOT kept").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingle similarity of 0.8 or more."""
    return minhash.keep_one(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Taken copies of documents in training order."""
    return mixing.curriculum(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document (copies alike)."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mix),
    ("SentencePiece encoding", piece_encoding),
]
#: Hashed likelihoods, automaton spans and merge-dropout are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row, each written to the shared folder and read by the next; what a stage needed goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/barsmith/pipeline-{k}-{uuid.uuid4().hex}"
        with scratch_scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            files.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
