"""A corpus pipeline: quality, near duplicates, secrets, source mix, sampled token ids.

``STAGES`` holds (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Null and empty texts go through all stages: they are scored like any text, linked with nothing, hold no secret, have size 0 (so the
mix never takes them). Very long texts are taken whole by each stage. Ties: the smallest doc_id of a group of near copies stays; quality is cut at a score, so
equal scores share their fate. Repeated rows go in as they are: near copies of one id stay together. Empty tables give empty results of the same
columns; further columns are handed on, and clash with no name that a stage makes up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import common, mixing, neardup, pieces, quality, secrets


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking, learnt from the labelled ones among them, rejects go."""
    return quality.keep_good(docs, quality.learn(docs, common.table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays: sets of five words, similarity of 0.8 or more."""
    return neardup.keep_one(docs, shingle=5)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, also those in encoded layers."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or parts of them, as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and sampled piece ids of every row."""
    return pieces.encode(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_near_copies),
    ("secret_scans", without_secrets),
    ("source_mixing", source_mix),
    ("sentencepiece_encoding", token_ids),
]
#: The stages are a fitted model, banding, decoding and sampling: none has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    where = common.shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"{where}/{k}-{name}")
    return docs
