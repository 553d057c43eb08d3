"""A training corpus from ``documents`` in five stages, each written as Parquet and reread as the next one's input.

Language identification drops what is in no learned language; near-duplicate groups keep the document with the
smallest id; benchmark passages are cut out, and documents of which nothing is left go; secrets are replaced by a
mark; and sources are mixed to their target weights, so that a document stands as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, langid, minhash, mixing, secrets
from loomtext.llm.storage import discard, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; keeps all columns."""
    return langid.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return minhash.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with ``benchmark``."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight has them taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs


#: Training and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
