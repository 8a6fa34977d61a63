"""Corpus cleaning: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept; ``run`` writes every
stage's result as Parquet in the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, packing, pii, simhash, toxicity
from ledgerlens.llm.common import read_table, store


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples vote toxic (score 0.5 or more) go."""
    seen = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.remove_toxic(docs, toxicity.fit(docs, seen))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (3-word shingles, 3 bits), the one with the smallest doc_id stays."""
    return simhash.deduplicate(docs, shingle=3, budget=3)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal-data span in a text is replaced by its kind in angle brackets; no document goes."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: the classifier, fingerprint and span stages cannot be stated in SQL; tests compare them with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
