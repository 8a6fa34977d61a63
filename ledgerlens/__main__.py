"""Command line: load a card-transaction file, or run every report.

    python -m ledgerlens ingest --csv creditcard.csv --out /data/fraud
    python -m ledgerlens report --tables /data/fraud --out /data/fraud/reports [--as-of "2024-02-01 00:00:00"]

``ingest`` runs the load (staging -> transactions with ids in time order ->
fraud cases by the label join), writes the three tables under ``--out`` and
prints the validation counts and label distribution. ``report`` reads the
transactions and fraud cases written by ``ingest`` (or any Parquet tables
with the same columns), runs every detection analysis, view and report, and
writes each result as a Parquet folder under ``--out``. An active session
(e.g. one created by ``spark-submit``) is used as is; otherwise a local
``local[*]`` session is started.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import detect, extras, ingest, params, report, views
from .plans.data import PaymentData

REPORTS = {
    "fraud_overview": detect.fraud_overview,
    "amount_threshold_sweep": detect.amount_threshold_sweep,
    "amount_flagged_top50": detect.amount_flagged_top,
    "hourly_fraud": views.hourly_fraud,
    "zscore_threshold_sweep": detect.zscore_threshold_sweep,
    "zscore_outliers_top50": detect.zscore_outliers_top,
    "v3_pattern_top100": detect.v3_pattern_top,
    "method_comparison": detect.method_comparison,
    "fraud_hourly_stats": views.fraud_hourly_stats,
    "high_risk_transactions": views.high_risk_transactions,
    "detection_performance_summary": views.detection_performance_summary,
    "analyze_fraud_by_parameters": params.analyze_fraud_by_parameters,
    "executive_summary": report.executive_summary,
    "hourly_financials": report.hourly_financials,
    "financial_impact": report.financial_impact,
    "segment_analysis": report.segment_analysis,
    "period_trends": report.period_trends,
    "operational_insights": report.operational_insights,
    "executive_dashboard": views.executive_dashboard,
    "segment_performance": views.segment_performance,
    "detector_extras": detect.detector_extras,
    "customer_rollup": extras.customer_rollup,
    "v3_profile": extras.v3_profile,
    "outlier_dominance": extras.outlier_dominance,
}
_STAMPED = {"high_risk_transactions", "executive_dashboard", "segment_performance"}


def _session() -> SparkSession:
    """The session that spark-submit (or the caller) configured; its master is never overridden."""
    return SparkSession.builder.appName("ledgerlens").getOrCreate()


def run_ingest(spark: SparkSession, csv: str, out: str) -> None:
    from .sources.card_csv import read_card_csv

    staging = ingest.write_staging(read_card_csv(spark, csv), f"{out}/staging")
    loaded = ingest.store_loaded(ingest.load_all(staging), out)
    ingest.validate_counts(loaded).show(truncate=False)
    ingest.fraud_distribution(loaded.fraud_cases).show(truncate=False)


def run_reports(spark: SparkSession, tables: str, out: str, as_of: str | None = None) -> list[str]:
    data = PaymentData(spark.read.parquet(f"{tables}/transactions"), spark.read.parquet(f"{tables}/fraud_cases"))
    data = data.materialize()  # one join for all reports
    written = []
    for name, build in REPORTS.items():
        df = build(data, as_of=as_of) if name in _STAMPED else build(data)
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens")
    sub = parser.add_subparsers(dest="command", required=True)
    p_in = sub.add_parser("ingest", help="load a card-transaction CSV into tables")
    p_in.add_argument("--csv", required=True)
    p_in.add_argument("--out", required=True)
    p_rep = sub.add_parser("report", help="run every analysis over loaded tables")
    p_rep.add_argument("--tables", required=True)
    p_rep.add_argument("--out", required=True)
    p_rep.add_argument("--as-of", default=None)
    args = parser.parse_args(argv)
    spark = _session()
    if args.command == "ingest":
        run_ingest(spark, args.csv, args.out.rstrip("/"))
    else:
        for name in run_reports(spark, args.tables.rstrip("/"), args.out.rstrip("/"), args.as_of):
            print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
