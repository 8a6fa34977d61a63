"""Analyses the data model prepares for but no report computes: the customer
rollup of the customer table, and a per-class profile of the V3 feature with
the dominance counts behind the outlier list.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import hour_of_day
from ..functions.numeric import cents, half_up_ratio, half_up_round
from ..operators.quantiles import exact_percentiles
from ..operators.stats import column_stats, with_stats, zscore
from .data import PaymentData
from .detect import outlier_scores


def customer_rollup(data: PaymentData, as_of=None, epoch: str | None = None) -> DataFrame:
    """One row per customer over all transactions (a hot customer costs
    nothing extra: partial aggregation runs before the shuffle). No risk
    formula exists, so the score keeps its default. ``created_date`` is the
    load's date (``as_of``, else today); transactions know only their second
    since the first one, so ``last_transaction_date`` needs that moment
    (``epoch``) and is NULL without it."""
    g = data.transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("amount").alias("total_amount"),
        F.max("transaction_time").alias("last_transaction_time"),
    )
    return g.select(
        "customer_id",
        "total_transactions",
        "total_amount",
        half_up_ratio(cents(F.col("total_amount")), F.col("total_transactions") * 100, 2).alias("avg_transaction_amount"),
        "last_transaction_time",
        (F.current_date() if as_of is None else F.to_date(F.lit(as_of))).alias("created_date"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + F.col("last_transaction_time")).alias("last_transaction_date"),
        F.lit(C.DEFAULT_RISK_SCORE).alias("risk_score"),
        F.lit(True).alias("is_active"),
    )


def amount_percentiles(data: PaymentData) -> DataFrame:
    """The 95th and 99th continuous percentiles of labelled amounts (the
    statistics the amount detector computes next to mean and deviation),
    exact and without gathering all amounts into one task."""
    return exact_percentiles(data.labelled, "amount", [("p95_amount", Decimal("0.95")),
                                                      ("p99_amount", Decimal("0.99"))])


def hourly_amount_percentiles(data: PaymentData) -> DataFrame:
    """Exact median, 95th and 99th percentile of the labelled amounts per hour of day."""
    rows = data.labelled.select(hour_of_day(F.col("transaction_time")).alias("hour_of_day"), "amount")
    return exact_percentiles(rows, "amount", [("p50_amount", Decimal("0.5")), ("p95_amount", Decimal("0.95")), ("p99_amount", Decimal("0.99"))],
                             by=["hour_of_day"])


def v3_profile(data: PaymentData) -> DataFrame:
    """Per label: count, exact mean (4 places), sample deviation (4 places),
    extremes of V3 and the rows beyond the statistical line (z > 3, z over
    all labelled rows)."""
    fact = data.labelled.select("v3", "is_fraud")
    scored = with_stats(fact, column_stats(fact, ["v3"])).withColumn("_z", zscore("v3"))
    g = scored.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("v3").alias("_sum"),
        F.count("v3").alias("_n"),
        F.stddev_samp(F.col("v3").cast("double")).alias("_sd"),
        F.min("v3").alias("v3_min"),
        F.max("v3").alias("v3_max"),
        F.count_if(F.col("_z") > F.lit(C.STATISTICAL_V3_Z)).alias("beyond_statistical_line"),
    )
    return g.select(
        "is_fraud",
        "transactions",
        half_up_ratio((F.col("_sum") * 1000000).cast("decimal(38,0)"), F.col("_n") * 1000000, 4).alias("v3_mean"),
        half_up_round(F.col("_sd"), 4).alias("v3_stddev"),
        "v3_min",
        "v3_max",
        "beyond_statistical_line",
    ).orderBy("is_fraud")


def outlier_dominance(data: PaymentData) -> DataFrame:
    """How often each feature dominates among all statistical outliers
    (average z > 3), by label — the outlier list without its limit."""
    rows = outlier_scores(data).where(F.col("_avg_z") > F.lit(C.OUTLIER_AVG_Z))
    return rows.groupBy("is_fraud", "dominant_outlier_feature").agg(
        F.count(F.lit(1)).alias("transactions")
    ).orderBy("is_fraud", "dominant_outlier_feature")
