"""The labelled fact: transactions joined with their fraud cases.

Inner equi-join on ``transaction_id``: a transaction without a case drops
out, a transaction with two cases appears twice. Both sides are large, so
Spark plans a shuffle (sort-merge) join; when the same labelled subtree is
used twice in one plan (statistics and the rows they score), the exchange is
reused rather than recomputed. Persist it (``materialize``) when several
reports read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FACT_COLUMNS = ("transaction_id", "customer_id", "transaction_time", "amount", "v1", "v2", "v3", "v4", "v5")


def labelled(transactions: DataFrame, fraud_cases: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    tx_cols = [c for c in (columns or FACT_COLUMNS) if c in transactions.columns]
    if "transaction_id" not in tx_cols:
        tx_cols = ["transaction_id", *tx_cols]
    return transactions.select(*tx_cols).join(
        fraud_cases.select("transaction_id", "is_fraud"), "transaction_id", "inner"
    )
