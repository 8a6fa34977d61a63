"""Cross-report invariants on the sf0.01 fixture."""
import pytest

from ledgerlens.plans import detect, params, report, views
from ledgerlens.plans.data import PaymentData

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return PaymentData.from_testdata(spark, SF)


def test_band_totals_equal_labelled_count(data):
    n = data.labelled.count()
    assert sum(r.total_transactions for r in report.segment_analysis(data).collect()) == n
    assert sum(r.total_transactions for r in report.period_trends(data).collect()) == n
    assert sum(r.total_transactions for r in views.fraud_hourly_stats(data).collect()) == n
    assert n == 10010


def test_sweeps_are_monotone_and_caught_within_flagged(data):
    for build in (detect.amount_threshold_sweep, detect.zscore_threshold_sweep):
        rows = sorted(build(data).collect(), key=lambda r: r.threshold_type)
        flagged = [r.flagged_transactions for r in rows]
        assert flagged == sorted(flagged, reverse=True)
        assert all(r.fraud_caught <= r.flagged_transactions for r in rows)


def test_known_counts(data):
    amount = {r.threshold_type: r.flagged_transactions for r in detect.amount_threshold_sweep(data).collect()}
    assert amount == {"1.0x StdDev": 203, "1.5x StdDev": 150, "2.0x StdDev": 138, "2.5x StdDev": 126,
                      "3.0x StdDev": 111}
    z = {r.threshold_type: r.flagged_transactions for r in detect.zscore_threshold_sweep(data).collect()}
    assert z == {"Z-score > 1.0": 181, "Z-score > 1.5": 86, "Z-score > 2.0": 81, "Z-score > 2.5": 78,
                 "Z-score > 3.0": 61}
    m = {r.detection_method: (r.total_flagged, r.fraud_caught) for r in detect.method_comparison(data).collect()}
    assert m["Amount-Based (2.5x StdDev)"] == (126, 10)
    assert m["Statistical Outlier (Z-score > 3.0)"] == (144, 19)
    assert m["V3 Pattern-Based (Advanced)"] == (6, 5)


def test_parameterised_function_equals_hourly_view(data):
    p = {r.hour_of_day: (r.total_transactions, r.fraud_count) for r in params.analyze_fraud_by_parameters(data).collect()}
    v = {r.hour_of_day: (r.total_transactions, r.fraud_count) for r in views.fraud_hourly_stats(data).collect()}
    assert p == v
    assert params.analyze_fraud_by_parameters(data, 5, 3).count() == 0


def test_view_counts_equal_comparison_counts(data):
    a = [(r.total_flagged, r.fraud_caught, r.precision_percentage) for r in
         sorted(detect.method_comparison(data).collect(), key=lambda r: r.detection_method)]
    b = [(r.total_flagged, r.fraud_caught, r.precision_percentage) for r in
         sorted(views.detection_performance_summary(data).collect(), key=lambda r: r.detection_method)]
    assert a == b
