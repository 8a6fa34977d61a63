"""The command line: CSV -> tables -> every report."""
from payment_helpers import SF_SMALL
from ledgerlens.__main__ import REPORTS, run_ingest, run_reports
from ledgerlens.sources import fixtures
from ledgerlens.sources.card_csv import write_card_csv
from ledgerlens.sources.testdata import read_table


def test_ingest_then_report(spark, scratch):
    write_card_csv(fixtures.raw_card_file(read_table(spark, SF_SMALL, "events")), f"{scratch}/card")
    run_ingest(spark, f"{scratch}/card", f"{scratch}/tables")
    assert spark.read.parquet(f"{scratch}/tables/transactions").count() == 1003
    assert spark.read.parquet(f"{scratch}/tables/fraud_cases").count() == 1004
    written = run_reports(spark, f"{scratch}/tables", f"{scratch}/reports", as_of="2024-02-01 00:00:00")
    assert written == list(REPORTS)
    methods = spark.read.parquet(f"{scratch}/reports/method_comparison").collect()
    assert len(methods) == 3
    dash = spark.read.parquet(f"{scratch}/reports/executive_dashboard").collect()[0]
    assert dash.total_transactions == 1004 and str(dash.report_timestamp).startswith("2024-02-01")
