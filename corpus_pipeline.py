"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the
shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftgrid.llm import bpe, mixing, pii, quality, simhash
from shiftgrid.llm.queries import table, vocabulary
from shiftgrid.llm.util import written

#: Columns of documents, that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good (score 0.3 or more); fitted on ``labels``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id: candidates by operator 9's
    SimHash links and by bands of minima, five-word shingles of a similarity of 0.8 or more as the exact check."""
    return simhash.keep_one(docs, width=5, similarity=0.8).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; every document stays."""
    return pii.redact(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is there as often as it is taken (0 to 2 times)."""
    return mixing.sample(docs).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to, a row for each row of the mix."""
    return bpe.encode(docs, vocabulary(), keep=("doc_id", "source"), digest=True)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: SQL cannot express the fitted, hashed and merged stages; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
