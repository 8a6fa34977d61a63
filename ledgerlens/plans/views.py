"""Operational views: hourly statistics, high-risk transactions, detection
performance, executive dashboard and segment performance.

Each view is a function returning a DataFrame: its SQL text (``view_sql.py``, the
one definition that ``catalog.create_views`` also stores) run over the given
tables; ``register_views`` publishes them as temporary SQL views under the names
users query, so
``SELECT * FROM high_risk_transactions WHERE recommended_action =
'IMMEDIATE_BLOCK'`` works as written. Views carry a ``report_timestamp`` /
``analysis_timestamp`` column (the query time, or a fixed ``as_of``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import hour_of_day
from ..functions.numeric import half_up_ratio
from . import view_sql
from .data import PaymentData


def _hourly_counts(data: PaymentData) -> DataFrame:
    """Per hour of day: total and fraud counts over labelled rows (at most 24
    groups after partial aggregation on every partition)."""
    return (
        data.labelled.select(hour_of_day(F.col("transaction_time")).alias("hour_of_day"), "is_fraud")
        .groupBy("hour_of_day")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col("is_fraud")).alias("fraud_count"),
            F.count_if(~F.col("is_fraud")).alias("normal_count"),
        )
    )


def _with_hour_shares(g: DataFrame, data: PaymentData) -> DataFrame:
    return g.crossJoin(F.broadcast(data.fraud_case_count())).withColumns(
        {
            "fraud_rate_percentage": half_up_ratio(F.col("fraud_count"), F.col("total_transactions"), 3, factor=100),
            "fraud_distribution_percentage": half_up_ratio(F.col("fraud_count"), F.col("n_fraud_cases"), 1, factor=100),
        }
    )


# --- P12 -------------------------------------------------------------------
def hourly_fraud(data: PaymentData) -> DataFrame:
    """Fraud rate per hour; distribution against all fraud cases flagged TRUE;
    riskiest hours first."""
    out = _with_hour_shares(_hourly_counts(data), data).select(
        "hour_of_day", "total_transactions", "fraud_count", "fraud_rate_percentage", "fraud_distribution_percentage"
    )
    return out.orderBy(F.col("fraud_rate_percentage").desc_nulls_first(), "hour_of_day")


def _defined(data: PaymentData, definition, **options) -> DataFrame:
    """A view's text over the labelled fact and the cases of ``data``."""
    return data.spark.sql(definition(**options), labelled=data.labelled, cases=data.fraud_cases)


# --- P17 -------------------------------------------------------------------
def fraud_hourly_stats(data: PaymentData) -> DataFrame:
    return _defined(data, view_sql.fraud_hourly_stats)


# --- P18 -------------------------------------------------------------------
def high_risk_transactions(data: PaymentData, as_of=None, include_timestamp: bool = True,
                           watch_z: float = C.MONITOR_V3_Z) -> DataFrame:
    """Every labelled row above the V3 watch line with its action."""
    return _defined(data, view_sql.high_risk_transactions, as_of=as_of, include_timestamp=include_timestamp, watch_z=watch_z)


# --- P19 -------------------------------------------------------------------
def detection_performance_summary(data: PaymentData) -> DataFrame:
    return _defined(data, view_sql.detection_performance_summary)


# --- P27 -------------------------------------------------------------------
def executive_dashboard(data: PaymentData, as_of=None, include_timestamp: bool = True) -> DataFrame:
    """One row over labelled rows; the average stays unrounded (DECIMAL(14,6))."""
    return _defined(data, view_sql.executive_dashboard, as_of=as_of, include_timestamp=include_timestamp)


# --- P28 -------------------------------------------------------------------
def segment_performance(data: PaymentData, as_of=None, include_timestamp: bool = True) -> DataFrame:
    return _defined(data, view_sql.segment_performance, as_of=as_of, include_timestamp=include_timestamp)


VIEW_BUILDERS = {
    "fraud_hourly_stats": fraud_hourly_stats,
    "high_risk_transactions": high_risk_transactions,
    "detection_performance_summary": detection_performance_summary,
    "executive_dashboard": executive_dashboard,
    "segment_performance": segment_performance,
}


def register_views(data: PaymentData) -> list[str]:
    """Publish every view (and the labelled fact) as a temporary SQL view."""
    data.labelled.createOrReplaceTempView("labelled_transactions")
    for name, build in VIEW_BUILDERS.items():
        build(data).createOrReplaceTempView(name)
    return ["labelled_transactions", *VIEW_BUILDERS]


def snapshot_views(data: PaymentData, base_path: str, as_of) -> dict[str, str]:
    """Materialise every view as a Parquet table partitioned by snapshot date
    (``as_of``), overwriting only that date's partition, so a rerun is
    idempotent and older snapshots stay readable."""
    written = {}
    for name, build in VIEW_BUILDERS.items():
        df = build(data, as_of=as_of) if name in ("high_risk_transactions", "executive_dashboard",
                                                   "segment_performance") else build(data)
        path = f"{base_path.rstrip('/')}/{name}"
        (df.withColumn("snapshot_date", F.to_date(F.lit(as_of).cast("timestamp")))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("snapshot_date").parquet(path))
        written[name] = path
    return written
