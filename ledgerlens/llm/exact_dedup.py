"""Exact dedup by tree-merged digest runs (DataFrame operations only).

Every row's normalised text becomes a digest (SHA-256, with byte length and
an independent 64-bit hash as verification). Rows are dealt into 2**RUN_BITS
runs by a hash of their position, whatever their text. Each run is reduced to
one entry per digest: smallest identifier, row count, verification. Runs then
merge in binomial rounds, 2**MERGE_BITS runs into one per round, until one run
is left; the way back down hands each run the surviving identifier. A text
that a third of all rows share is therefore never one shuffle key: it is at
most one entry per run on the way up and a run's share of rows on the way down.

Defined results: a null text equals the empty text; a null identifier loses to
any other, and a group of null identifiers keeps one row under a null keep_id;
of repeated rows with the smallest identifier one is kept (the first in input
position); texts of any length are digested whole; an empty table gives an
empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACES, keep_one_per, smallest_id, store, text_or_empty

RUN_BITS = 6
MERGE_BITS = 3

_DIGEST = ["text_sha256", "n_bytes", "check_hash"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = df.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("t"))
    return norm.select(
        "doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"), F.octet_length("t").cast("long").alias("n_bytes"),
        F.xxhash64("t").alias("check_hash"), F.monotonically_increasing_id().alias("pos"))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           run_bits: int = RUN_BITS, merge_bits: int = MERGE_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and pos, the row's position).

    The verification columns are part of every merge key, so two texts are one
    group only if digest, length and second hash all agree.
    """
    rows = store(digests(df, id_col, text_col), "dedup-digests")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("pos"), F.lit(1 << run_bits)).cast("int"))
    entry = smallest_id(F.col("doc_id"), F.col("pos"))
    level = rows.groupBy("run", *_DIGEST).agg(F.min(entry).alias("best"), F.count("*").alias("members"))
    levels, left = [level], run_bits
    while left > 0:  # up: merge 2**merge_bits runs into one
        left = max(0, left - merge_bits)
        up = F.col("run") if left == 0 and run_bits == 0 else F.shiftright("run", min(merge_bits, run_bits))
        level = level.withColumn("run", up).groupBy("run", *_DIGEST).agg(
            F.min("best").alias("best"), F.sum("members").alias("members"))
        levels.append(level)
    found = levels[-1].select("run", *_DIGEST, "best", "members")
    for below in reversed(levels[:-1]):  # down: each run learns the survivor of its digests
        own = below.select(F.col("run").alias("own"), F.shiftright("run", min(merge_bits, run_bits)).alias("run"), *_DIGEST)
        found = own.join(found, ["run", *_DIGEST]).select(F.col("own").alias("run"), *_DIGEST, "best", "members")
    return rows.join(found, ["run", *_DIGEST]).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("members").alias("group_size"),
        (F.col("pos") == F.col("best.pos")).alias("kept"), "text_sha256", "pos")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    verdict = store(decide(df, id_col, text_col).select("doc_id", "kept", "text_sha256"), "dedup-verdicts")
    stay = verdict.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(normalised(F.col(f"`{text_col}`")), 256)
    tagged = df.withColumn("__sha_own", sha)
    match = tagged["__sha_own"].eqNullSafe(stay["__sha"]) & tagged[f"`{id_col}`"].eqNullSafe(stay["__id"])
    kept = tagged.join(stay, match, "left_semi")
    twice = (verdict.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
             .filter("n > 1 AND kept"))
    if twice.isEmpty():  # no repeated identifiers: every kept row is already alone
        return kept.drop("__sha_own")
    again = twice.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    match = kept["__sha_own"].eqNullSafe(again["__sha"]) & kept[f"`{id_col}`"].eqNullSafe(again["__id"])
    single = kept.join(again, match, "left_anti")
    repeated = keep_one_per(kept.join(again, match, "left_semi"), [id_col, "__sha_own"])
    return single.unionByName(repeated).drop("__sha_own")
