"""Transactions, fraud cases and the raw card file, derived from ``events``.

The payment model (transactions with PCA-style features, a label table, a
raw CSV-shaped file) is mapped onto the generic ``events`` table by the rules
in FIXTURES.md. Every derivation is a narrow projection of one scan of
``events`` (no shuffle); the work grows linearly with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import N_FEATURES

# fixed values: the fixture's multipliers for the 28 raw features (FIXTURES.md §5)
RAW_FEATURE_MULTIPLIERS = (
    7919, 104729, 1299709, 15485863, 32452843, 7, 11, 13, 17, 19, 23, 29, 31, 37,
    41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101,
)
FOLD_SECONDS = 172800  # 30 days of events folded onto the two observed days


def _base(m: int) -> str:
    return f"CAST((event_id * {m}) % 2001 - 1000 AS DECIMAL(10,6)) * CAST(0.001 AS DECIMAL(4,3))"


_TIME = f"CAST(unix_timestamp(ts) % {FOLD_SECONDS} AS INT)"
_AMOUNT = (
    "CAST(CASE WHEN event_id % 499 = 0 THEN CASE event_id % 4 WHEN 0 THEN 99.99 WHEN 1 THEN 1.00 "
    "WHEN 2 THEN 0.01 ELSE 5.00 END "
    "WHEN event_id % 50 = 7 THEN CAST(value AS DECIMAL(10,2)) * 20 "
    "ELSE CAST(value AS DECIMAL(10,2)) END AS DECIMAL(10,2))"
)
_TX_FEATURES = {
    "v1": f"CASE WHEN event_id % 499 = 0 THEN -15 WHEN event_id % 499 = 250 THEN 25 ELSE {_base(7919)} END",
    "v2": f"CASE WHEN event_id % 499 = 0 THEN 8 ELSE {_base(104729)} END",
    "v3": (
        "CASE WHEN event_id % 1497 = 0 THEN -75 WHEN event_id % 499 = 0 THEN -52 "
        f"WHEN event_id % 499 = 125 THEN -45 WHEN event_id % 97 = 31 THEN -18 ELSE {_base(1299709)} END"
    ),
    "v4": f"CASE WHEN event_id % 499 = 0 THEN 9 ELSE {_base(15485863)} END",
    "v5": f"CASE WHEN event_id % 499 = 0 THEN -20 WHEN event_id % 499 = 100 THEN 50 ELSE {_base(32452843)} END",
}
_FRAUD = "((event_id % 499 = 0 AND event_id % 7 <> 3) OR (event_type = 'error' AND event_id % 20 = 7))"


def transactions(events: DataFrame, keep=()) -> DataFrame:
    """The standard fixture ``tx`` (FIXTURES.md §3); ``keep`` adds columns of
    ``events`` (e.g. the event time for a stream)."""
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.expr(_TIME).alias("transaction_time"),
        F.expr(_AMOUNT).alias("amount"),
        *[F.expr(f"CAST({e} AS DECIMAL(10,6))").alias(v) for v, e in _TX_FEATURES.items()],
        *keep,
    )


def _case_array():
    """Zero, one or two case structs per event."""
    label = F.expr(f"CASE WHEN {_FRAUD} THEN TRUE ELSE FALSE END")
    eid = F.col("event_id")
    return F.filter(
        F.array(
            F.struct(F.lit(True).alias("keep"), label.alias("is_fraud")),
            F.struct(F.lit(False).alias("keep"), (~label).alias("is_fraud")),
        ),
        lambda c: F.when(c["keep"], (eid % 1000) != 3).otherwise((eid % 500) == 2),
    )


def fraud_cases(events: DataFrame) -> DataFrame:
    """The standard fixture ``fc`` (FIXTURES.md §4): most transactions have one
    case, some none and some two contradicting ones.

    One scan: each event yields zero, one or two case rows through a
    generator, instead of a union that would read ``events`` twice.
    """
    return events.select(F.col("event_id").alias("transaction_id"), F.inline(_case_array())).select(
        "transaction_id", "is_fraud"
    )


def raw_card_file(events: DataFrame) -> DataFrame:
    """The ingest fixture ``raw`` (FIXTURES.md §5), in the delivered file's
    column names (Time, V1..V28, Amount, Class).

    Copies of rows (an exact duplicate for ``event_id % 1000 = 1``, a copy with
    the class flipped for ``= 2``, a copy with class 2 for ``= 5``) come from a
    per-row generator: one scan. Rows with ``event_id % 1000 = 4`` have no class.
    """
    eid = F.col("event_id")
    fraud = F.expr(f"CASE WHEN {_FRAUD} THEN 1 ELSE 0 END")
    feats = []
    for i, m in enumerate(RAW_FEATURE_MULTIPLIERS, start=1):
        # thousandths plus (event_id % 10) * 1e-7, in units of the last of 10 places: one decimal product
        e = (
            f"CAST(CAST(((event_id * {m}) % 2001 - 1000) * 10000000 + (event_id % 10) * 1000 AS DECIMAL(12,0)) "
            "* CAST(0.0000000001 AS DECIMAL(10,10)) AS DECIMAL(15,10))"
        )
        c = F.expr(e)
        if i == N_FEATURES:
            c = F.when((eid % 1000) != 3, c)
        feats.append(c.alias(f"V{i}"))
    copies = F.when((eid % 1000).isin(1, 2, 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = events.select(
        F.expr(_TIME).alias("Time"), *feats, F.expr(_AMOUNT).alias("Amount"),
        fraud.alias("_class"), eid.alias("_eid"), F.explode(copies).alias("_copy"),
    )
    kind, copy = F.col("_eid") % 1000, F.col("_copy") == 1
    label = (F.when(copy & (kind == 2), 1 - F.col("_class")).when(copy & (kind == 5), 2)
             .when(kind == 4, F.lit(None).cast("int")).otherwise(F.col("_class")))
    return rows.withColumn("Class", label).drop(
        "_class", "_eid", "_copy"
    )
