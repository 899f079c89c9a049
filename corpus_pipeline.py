"""A training corpus from raw documents: drop toxic, bad and repeated documents, then pack the rest into sequences.

Every stage works on all that the one before it kept; its result is written to the shared folder and read back, and what it wrote on the way
and the result before it are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugegrid.llm import packing, perfect_hash, quality, simhash, toxicity
from gaugegrid.llm.common import discard, table, tidied

#: SQL cannot express the fitted field of the first stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return perfect_hash.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_bad),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, tidied(lambda: stage(spark, docs, sf_dir))
        discard(before)
    return docs
