"""Physical-plan shape: no global window, no un-aggregated single partition."""
import pytest

from payment_helpers import SF_SMALL
from ledgerlens.plans import detect, report, views
from ledgerlens.plans.data import PaymentData


def plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def single_partition_children(lines):
    """The operator right under every 'Exchange SinglePartition'."""
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            out.append(lines[i + 1])
    return out


@pytest.mark.parametrize("build", [
    detect.amount_threshold_sweep, detect.zscore_threshold_sweep, detect.zscore_outliers_top,
    detect.v3_pattern_top, detect.method_comparison, views.fraud_hourly_stats, report.period_trends,
])
def test_no_global_window_over_fact_rows(spark, build):
    lines = plan_lines(build(PaymentData.from_testdata(spark, SF_SMALL)))
    assert not any(" Window " in line or line.strip().startswith("Window") or "+- Window" in line for line in lines)
    for child in single_partition_children(lines):
        assert "HashAggregate" in child and "partial_" in child, child


def test_statistics_are_broadcast_one_row(spark):
    lines = plan_lines(detect.method_comparison(PaymentData.from_testdata(spark, SF_SMALL)))
    text = "\n".join(lines)
    assert "BroadcastNestedLoopJoin" in text and "BroadcastExchange" in text


def test_sweep_scans_events_once_per_side(spark):
    # one conditional-aggregate pass: the UNION ALL form would scan once per detector
    text = "\n".join(plan_lines(detect.amount_threshold_sweep(PaymentData.from_testdata(spark, SF_SMALL))))
    assert text.count("Union") == 0


def test_filters_and_columns_reach_the_scan(spark):
    # derived from the raw table: only the used columns are read
    text = "\n".join(plan_lines(report.executive_summary(PaymentData.derive_from_testdata(spark, SF_SMALL))))
    assert "ReadSchema: struct<event_id:bigint" in text
    assert "props" not in text and "user_id" not in text  # pruned everywhere
    # on the stored tables: the label filter reaches the scan, features are not read
    text = "\n".join(plan_lines(report.executive_summary(PaymentData.from_testdata(spark, SF_SMALL))))
    assert "PushedFilters: [IsNotNull(is_fraud), EqualTo(is_fraud,true)]" in text
    assert all("v1" not in line for line in text.splitlines() if "ReadSchema" in line)


def test_operational_insights_takes_three_scans_and_four_exchanges(spark):
    df = report.operational_insights(PaymentData.from_testdata(spark, SF_SMALL))
    lines = plan_lines(df)  # before it runs: the initial plan only
    assert sum("FileScan" in line for line in lines) == 3  # labelled rows twice, transactions once
    assert sum(" Exchange " in line for line in lines) == 4
    assert sum("BroadcastExchange" in line for line in lines) == 2  # one row each


@pytest.mark.parametrize("rows", [[], [(1, "1.50")], [(1, "1.50"), (2, None), (2, "4.25"), (3, "4.25"), (3, "-100.00")], [(1, None), (2, None)]])
def test_merged_moments_are_those_of_all_rows(spark, rows):
    from decimal import Decimal

    from ledgerlens.operators.stats import column_stats, merged_stats, moments

    df = spark.createDataFrame([(k, None if x is None else Decimal(x)) for k, x in rows], "k int, x decimal(10,2)")
    whole = column_stats(df, ["x"]).first()
    merged = merged_stats(df.groupBy("k").agg(moments("x").alias("x")), ["x"]).first()
    for a, b in zip(whole, merged):
        assert (a is None and b is None) or abs(a - b) <= 1e-12 * abs(a)
