"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_dedup, packing, pii, quality
from tidemark.llm.queries import table
from tidemark.llm.shared import leave_out, materialize
from tidemark.llm.tokens import tokenizer_path

#: Wanted shares of the tokens; no target for low quality, which the first stage rejects.  Memberships are soft: a
#: document that says nothing of a domain still has its prior, so a share far below that could only be met by
#: dropping most clean documents.
WEIGHTS = {"good": 0.85, "good_toxic": 0.15}


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier rejects go, whatever their id."""
    return leave_out(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; of repeated rows one."""
    return near_dedup.one_of_each(docs, shingle=5, similarity=(80, 100))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets, and n_chars the new length."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay by their rates, which are at most 1, so that a document is written once at most and shares hold."""
    return leave_out(docs, mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, most=1.0).where("copies = 0"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [("quality", classified), ("near_dedup", deduplicated), ("pii", redacted), ("mixing", mixed), ("packing", packed)]
#: No SQL states the classifier's or the packing's rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
