"""Appending files to the loaded tables, safe to repeat.

Each delivered file is a batch with a key. Its staging rows, transactions and
fraud cases are one folder each (``batch_id=...``) of the three tables, so loading
the batch again replaces those folders and nothing else. A ledger, one row per
batch, is written last: it makes a batch visible (``read_appended`` reads the
ledger's batches only, by partition pruning), and it remembers the batch's content
(row count and an order-free digest) and the last ids handed out.

* A batch whose key and content are in the ledger is not loaded again.
* A batch that failed half-way is not in the ledger: the repeated load gets the
  same ids and overwrites what the failed one left.
* A known key with other content is an error, or with ``replace=True`` takes the
  place of the first delivery, with ids of its own above all others.

Transaction and case ids continue from the largest of the ledger, so no table is
read to find them. Labels are joined within a batch: a file carries the labels of
its own rows. One load runs at a time; readers may run beside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import Loaded, _moment, load_all

PARTS = ("staging", "transactions", "fraud_cases")
LEDGER = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("row_count", T.LongType()), T.StructField("content", T.StringType()),
    T.StructField("last_transaction_id", T.LongType()), T.StructField("last_case_id", T.LongType()),
    T.StructField("loaded_at", T.TimestampType())])


@dataclass
class Appended:
    """What a call did: ``loaded`` is False for a batch that was there already."""

    batch_id: str
    loaded: bool
    first_transaction_id: int
    first_case_id: int


def _ledger_path(base_path: str) -> str:
    return f"{base_path.rstrip('/')}/ledger"


def read_ledger(spark: SparkSession, base_path: str) -> DataFrame:
    """One row per batch that is loaded; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_ledger_path(base_path))
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(_ledger_path(base_path))


def content_of(staging: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a batch, whatever the order of its rows."""
    hashes = [F.xxhash64(F.lit(salt), *staging.columns).cast("decimal(38,0)") for salt in (1, 2)]
    n, a, b = staging.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0)) for h in hashes]).first()
    return n, f"{a:f}/{b:f}"


def append_batch(staging: DataFrame, base_path: str, batch_id: str, as_of=None, replace: bool = False) -> Appended:
    """Load a batch of staging rows into the tables under ``base_path``."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
        raise ValueError(f"batch key {batch_id!r}: letters, digits, dot, dash and underscore only")
    spark, base = staging.sparkSession, base_path.rstrip("/")
    ledger = read_ledger(spark, base)
    last_tx, last_case = ledger.agg(F.coalesce(F.max("last_transaction_id"), F.lit(0)), F.coalesce(F.max("last_case_id"), F.lit(0))).first()
    known = ledger.where(F.col("batch_id") == batch_id).select("row_count", "content").first()
    if known is not None:
        if tuple(known) == content_of(staging):
            return Appended(batch_id, False, last_tx + 1, last_case + 1)
        if not replace:
            raise ValueError(f"batch {batch_id!r} is loaded with other rows; replace=True puts these in their place")
    # one evaluation of the input, which may read the tables; a new batch is invisible until its ledger row
    staged = f"{base}/staging/batch_id={batch_id}" if known is None else f"{base}/incoming/batch_id={batch_id}"
    staging.write.mode("overwrite").parquet(staged)
    staging = spark.read.parquet(staged).select(*staging.columns)
    rows, content = content_of(staging)
    loaded = load_all(staging, as_of)
    shifted = {
        "staging": staging,
        "transactions": loaded.transactions.withColumn("transaction_id", F.col("transaction_id") + last_tx),
        "fraud_cases": loaded.fraud_cases.withColumns({"transaction_id": F.col("transaction_id") + last_tx, "case_id": F.col("case_id") + last_case}),
    }
    for part in PARTS if known is not None else PARTS[1:]:
        shifted[part].write.mode("overwrite").parquet(f"{base}/{part}/batch_id={batch_id}")
    tx, cases = (spark.read.parquet(f"{base}/{part}/batch_id={batch_id}") for part in PARTS[1:])
    entry = (tx.agg(F.coalesce(F.max("transaction_id"), F.lit(last_tx)).alias("last_transaction_id"))
             .crossJoin(cases.agg(F.coalesce(F.max("case_id"), F.lit(last_case)).alias("last_case_id")))
             .select(F.lit(rows).cast("long").alias("row_count"), F.lit(content).alias("content"),
                     F.col("last_transaction_id").cast("long"), F.col("last_case_id").cast("long"), _moment(as_of).alias("loaded_at")))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{_ledger_path(base)}/batch_id={batch_id}")
    return Appended(batch_id, True, last_tx + 1, last_case + 1)


def read_appended(spark: SparkSession, base_path: str) -> Loaded:
    """The tables over all loaded batches, with ``batch_id``."""
    batches = [r.batch_id for r in read_ledger(spark, base_path).select("batch_id").collect()]  # one per delivered file
    if not batches:
        raise ValueError(f"no batch is loaded under {base_path}")
    base = base_path.rstrip("/")
    return Loaded(*(spark.read.option("basePath", f"{base}/{part}").parquet(*[f"{base}/{part}/batch_id={b}" for b in batches])
                    .withColumn("batch_id", F.col("batch_id").cast("string")) for part in PARTS))
