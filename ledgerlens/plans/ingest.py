"""Ingest: staging file -> transactions (ids in time order) -> fraud cases
(label join), with load validation and data-quality checks.

Two ways to label transactions are offered:

* ``load_fraud_cases`` reproduces the label join on 30 keys (amount, time and
  the 28 features rounded to 6 places) with its DISTINCT. Both sides carry the
  SHA-256 of the 30 keys in the table's declared types, written out, instead of
  the keys: 32 bytes a row are moved, not 30 columns. The first half is the join
  key, the second half verifies each match. The staging side is reduced to
  distinct (digest, is fraud) rows *before* the join (a plain hash
  aggregate, at most two rows per key), so a group of k identical source rows
  yields at most 2 cases per transaction instead of a k x k fan-out, and no
  DISTINCT pass is needed after the join. Both sides of the join are plain
  shuffles, so AQE can split a hot key of the transaction side.
* ``carry_label`` keeps the class through the id assignment: one pass, no
  join. It equals the label join when no two source rows share all 30 keys
  with different classes and no key is NULL.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import half_up_ratio
from ..operators.ids import assign_sequential_ids, materialize_ordered, number_ordered, ranges_for
from ..operators.quality import duplicate_keys, null_counts, referential_counts
from ..operators.reshape import rows_from_one
from ..schema import FEATURES
from ..session import checkpoint_path, is_live
from ..sources import fixtures
from ..sources.card_csv import to_staging
from ..sources.testdata import read_table, source_state
from .data import PaymentData


#: bytes of events whose staging rows one task derives
BYTES_PER_DEAL = 8 << 20


def staging_of(events: DataFrame) -> DataFrame:
    """Staging rows of some events: the fixture rows in the delivered file
    layout, through the same mapping the CSV reader uses. The events are dealt
    out first: their few columns are cheap to move, the 28 derived ones are not
    cheap to compute, and a split of a file may hold no row group, or all of it."""
    cores = events.sparkSession.sparkContext.defaultParallelism
    waves = -(-ranges_for(events, BYTES_PER_DEAL) // cores)
    return to_staging(fixtures.raw_card_file(events.repartition(cores * waves)))


def staging_from_testdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging table (P01) for a test-data folder."""
    return staging_of(read_table(spark, sf_dir, "events"))


def _rounded_features(df: DataFrame) -> list:
    return [F.round(F.col(v), 6).cast("decimal(10,6)").alias(v) for v in FEATURES]


_ORDER_COLUMNS = ["transaction_time", "amount", *FEATURES, "class"]


def _ordered_rows(staging: DataFrame, digest: bool = False) -> DataFrame:
    """Staging rows with rounded features, in load order, written once; with
    ``digest`` also ``_digest`` of their 30 label keys."""
    rows = staging.select(
        F.col("time_seconds").alias("transaction_time"), "amount", *_rounded_features(staging), "class",
    )
    keys = {"_digest": key_digest(F.col("amount"), F.col("transaction_time"), [F.col(v) for v in FEATURES])} if digest else {}
    return materialize_ordered(rows, [F.col(c).asc_nulls_first() for c in _ORDER_COLUMNS], derived=keys)


def _transactions_from_ordered(ordered: DataFrame, audit_columns: bool = False, keep_class: bool = False, as_of=None) -> DataFrame:
    with_ids = number_ordered(ordered, "transaction_id")
    cols = [F.col("transaction_id"), F.lit(None).cast("bigint").alias("customer_id"), "amount", "transaction_time"]
    if audit_columns:
        cols.append(F.lit(None).cast("timestamp").alias("transaction_timestamp"))
    cols += FEATURES
    if audit_columns:
        cols.append(_moment(as_of).alias("created_at"))
    if keep_class:
        cols.append("class")
    return with_ids.select(*cols)


def load_transactions(staging: DataFrame, audit_columns: bool = False, keep_class: bool = False) -> DataFrame:
    """Transactions (P02): features rounded to 6 places, ids 1..n in
    ``time_seconds`` order (ties broken by amount, features and class)."""
    return _transactions_from_ordered(_ordered_rows(staging), audit_columns, keep_class)


def _is_fraud() -> Column:
    """The label of a class code: 1 is fraud; any other code, and none, is not."""
    return F.coalesce(F.col("class") == 1, F.lit(False))


def _case_columns() -> list:
    fraud = F.col("is_fraud")
    return [
        "transaction_id",
        F.lit(None).cast("bigint").alias("customer_id"),
        "is_fraud",
        F.lit(C.LABEL_METHOD).alias("detection_method"),
        F.when(fraud, F.lit(C.FRAUD_PROBABILITY)).otherwise(F.lit(C.NORMAL_PROBABILITY))
        .cast("decimal(5,4)").alias("fraud_probability"),
    ]


def key_digest(amount: Column, time: Column, features: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the 30 label keys; NULL if any of them is."""
    keys = [amount.cast("decimal(10,2)"), time.cast("int"), *[f.cast("decimal(10,6)") for f in features]]
    written = [part for k in keys for part in (k.cast("string"), F.lit("|"))]
    return F.unhex(F.sha2(F.concat(*written), 256))


def load_fraud_cases(transactions: DataFrame, staging: DataFrame) -> DataFrame:
    """Fraud cases (P06) by the 30-key label join; NULL keys match nothing.

    The label side is the distinct (digest, is_fraud) rows: clustered on all
    three columns, it is shuffled again for the join on one, like the transaction
    side. That second shuffle of an already reduced table is what lets AQE's
    skew-join handling split a hot key (it never splits a partition that an
    aggregate below the join still needs whole).
    """
    rounded = [F.round(F.col(v), 6) for v in FEATURES]
    labels = staging.select("class", key_digest(F.col("amount"), F.col("time_seconds"), rounded).alias("_digest"))
    own = transactions.select("transaction_id", key_digest(F.col("amount"), F.col("transaction_time"), [F.col(v) for v in FEATURES]).alias("_digest"))
    return _cases_by_digest(own, labels)


def _cases_by_digest(own: DataFrame, labels: DataFrame) -> DataFrame:
    """The label join of (transaction_id, _digest) with (class, _digest)."""
    halves = [F.substring("_digest", 1, 16).alias("_key"), F.substring("_digest", 17, 16).alias("_rest")]
    labels = labels.select(*halves, _is_fraud().alias("is_fraud")).where(F.col("_key").isNotNull()).distinct()
    joined = own.select("transaction_id", *halves).join(labels.withColumnRenamed("_rest", "_verify"), "_key").where(F.col("_rest") == F.col("_verify"))
    return joined.select(*_case_columns())


def carry_label(transactions_with_class: DataFrame) -> DataFrame:
    """Fraud cases straight from a class column kept through the load."""
    return transactions_with_class.withColumn("is_fraud", _is_fraud()).select(*_case_columns())


def _moment(as_of) -> Column:
    """The load's time: now, or the given one (for repeatable loads)."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def with_case_ids(cases: DataFrame, as_of=None) -> DataFrame:
    """case_id 1..n in (transaction_id, is_fraud) order, plus the defaulted
    columns of the case table."""
    order = [F.col("transaction_id").asc_nulls_first(), F.col("is_fraud").asc_nulls_first()]
    return assign_sequential_ids(cases, order, "case_id").select(
        "case_id", *[c for c in cases.columns],
        F.lit("pending").alias("investigation_status"),
        _moment(as_of).alias("reported_date"),
        F.lit(None).cast("timestamp").alias("resolved_date"),
        F.lit(0).cast("decimal(10,2)").alias("financial_loss"),
    )


@dataclass
class Loaded:
    staging: DataFrame
    transactions: DataFrame
    fraud_cases: DataFrame

    def as_payment_data(self) -> PaymentData:
        return PaymentData(self.transactions, self.fraud_cases)


def load_all(staging: DataFrame, as_of=None) -> Loaded:
    """Staging -> transactions -> fraud cases, both with all their columns. The
    ordered, rounded staging rows are written once, with the digest of their
    label keys; the ids and both sides of the label join read that table (its
    rows are the staging rows and the transactions alike), so the staging input
    is computed once and each row's keys are rounded and digested once."""
    ordered = _ordered_rows(staging, digest=True)
    tx = _transactions_from_ordered(ordered, audit_columns=True, as_of=as_of)
    own = number_ordered(ordered.select("_pid", "_pos", "_digest"), "transaction_id")
    return Loaded(staging, tx, with_case_ids(_cases_by_digest(own, ordered.select("class", "_digest")), as_of))


def write_staging(staging: DataFrame, path: str | None = None) -> DataFrame:
    """Land the staging rows as a table (the load's first sink), overwriting,
    so a rerun is idempotent; later passes read columnar files instead of
    re-parsing or re-deriving the source."""
    spark = staging.sparkSession
    path = path or checkpoint_path(spark, f"staging/{uuid.uuid4().hex}")
    staging.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_from_testdata(spark: SparkSession, sf_dir: str, as_of=C.TEST_LOAD_TIME) -> Loaded:
    """Run the whole load for a test-data folder (lazy after the writes), at a fixed load time."""
    return load_all(write_staging(staging_from_testdata(spark, sf_dir)), as_of)


def store_loaded(loaded: Loaded, path: str) -> Loaded:
    """Write the loaded transactions and fraud cases as tables and read them
    back (the staging table is already stored)."""
    loaded.transactions.write.mode("overwrite").parquet(f"{path}/transactions")
    loaded.fraud_cases.write.mode("overwrite").parquet(f"{path}/fraud_cases")
    read = loaded.staging.sparkSession.read.parquet
    return Loaded(loaded.staging, read(f"{path}/transactions"), read(f"{path}/fraud_cases"))


_LOADS: dict = {}


def loaded_from_testdata(spark: SparkSession, sf_dir: str) -> Loaded:
    """The loaded tables of a test-data folder, loaded once per session (as
    the setup script loads once and its validation queries read the tables)."""
    key = (sf_dir, source_state(spark, sf_dir, "events"))
    cached = _LOADS.get(key)
    if cached is None or cached[0] is not spark or not is_live(spark):
        stored = store_loaded(load_from_testdata(spark, sf_dir), checkpoint_path(spark, f"loaded/{uuid.uuid4().hex}"))
        _LOADS[key] = cached = (spark, stored)
    return cached[1]


# --- P07 / P08 -----------------------------------------------------------------
def validate_counts(loaded: Loaded) -> DataFrame:
    """Three rows: row counts of staging, transactions and fraud cases."""
    (n1, d1), (n2, d2), (n3, d3) = C.VALIDATION_ROWS
    counts = (
        loaded.staging.agg(F.count(F.lit(1)).alias("a"))
        .crossJoin(loaded.transactions.agg(F.count(F.lit(1)).alias("b")))
        .crossJoin(loaded.fraud_cases.agg(F.count(F.lit(1)).alias("c")))
    )
    return rows_from_one(counts, ["table_name", "row_count", "description"],
                         [(n1, F.col("a"), d1), (n2, F.col("b"), d2), (n3, F.col("c"), d3)])


def fraud_distribution(fraud_cases: DataFrame) -> DataFrame:
    """Cases per label with the share of all cases (2 places), FALSE first."""
    g = fraud_cases.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("case_count"))
    total = F.sum("case_count").over(Window.partitionBy())  # over <= 3 grouped rows
    return g.select(
        "is_fraud", "case_count", half_up_ratio(F.col("case_count"), total, 2, factor=100).alias("percentage")
    ).orderBy(F.col("is_fraud").asc_nulls_first())


# --- P03 - P05 -----------------------------------------------------------------
def dq_not_null(data: PaymentData) -> DataFrame:
    return null_counts(data.transactions, "analytics.transactions", ["amount", "transaction_time"]).unionByName(
        null_counts(data.fraud_cases, "fraud_detection.fraud_cases", ["is_fraud"])
    )


def dq_unique_key(data: PaymentData) -> DataFrame:
    """The tables' own keys; a transaction may have several cases, so a case's key is ``case_id``."""
    return duplicate_keys(data.transactions, "analytics.transactions", "transaction_id").unionByName(
        duplicate_keys(data.fraud_cases, "fraud_detection.fraud_cases", "case_id")
    )


def dq_orphans(data: PaymentData) -> DataFrame:
    return referential_counts(data.fraud_cases, data.transactions, "transaction_id", "fraud case", "transaction")
