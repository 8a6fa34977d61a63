"""Semantics the reports must keep (boundary rows, NULL rules, small samples)."""
import math
from decimal import Decimal

from pyspark.sql import functions as F

from payment_helpers import make_data
from ledgerlens.functions import bands
from ledgerlens.plans import detect, report, views

# (id, time, amount, fraud) -> hour, segment, period, value band (FIXTURES.md §6)
GOLDEN = [
    (1, 0, "10.00", False, 0, "Micro", 1, 1),
    (2, 14399, "10.01", False, 3, "Small", 1, 1),
    (3, 14400, "50.00", False, 4, "Small", 2, 1),
    (4, 86399, "50.01", False, 23, "Medium", 6, 2),
    (5, 86400, "200.00", True, 0, "Medium", 1, 2),
    (6, 100799, "200.01", False, 3, "Large", 1, 2),
    (7, 158400, "1000.00", True, 20, "Large", 6, 3),
    (8, 172799, "1000.01", False, 23, "Premium", 6, 3),
    (9, 7200, "99.99", True, 2, "Medium", 1, 2),
    (10, 7201, "0.01", False, 2, "Micro", 1, 1),
    (11, 7202, "1.00", False, 2, "Micro", 1, 1),
    (12, 158399, "500.00", False, 19, "Large", 5, 2),
    (13, 43200, "500.01", False, 12, "Large", 4, 3),
]


def golden_data(spark):
    return make_data(spark, [(g[0], g[1], g[2]) for g in GOLDEN], [(g[0], g[3]) for g in GOLDEN])


def test_golden_bands(spark):
    data = golden_data(spark)
    got = data.labelled.select(
        "transaction_id",
        bands.hour_of_day(F.col("transaction_time")).alias("h"),
        bands.amount_segment(F.col("amount"), short=True).alias("s"),
        bands.time_period_rank(F.col("transaction_time")).alias("p"),
        bands.value_band_rank(F.col("amount")).alias("v"),
    ).collect()
    got = {r.transaction_id: (r.h, r.s, r.p, r.v) for r in got}
    for g in GOLDEN:
        assert got[g[0]] == tuple(g[4:]), g


def test_golden_segment_totals_keep_null_loss(spark):
    rows = {r.segment: r for r in views.segment_performance(golden_data(spark), include_timestamp=False).collect()}
    expect = {"Micro": (3, 0, "11.01", None), "Small": (2, 0, "60.01", None), "Medium": (3, 2, "350.00", "299.99"),
              "Large": (4, 1, "2200.02", "1000.00"), "Premium": (1, 0, "1000.01", None)}
    for seg, (n, f, vol, fvol) in expect.items():
        r = rows[seg]
        assert (r.transactions, r.fraud_count, r.volume) == (n, f, Decimal(vol))
        assert r.fraud_volume == (None if fvol is None else Decimal(fvol))
        assert (r.loss_rate is None) == (fvol is None)
    seg_text = {r.amount_segment: r for r in report.segment_analysis(golden_data(spark)).collect()}
    assert seg_text["Micro (≤€10)"].fraud_loss is None  # '€' || NULL stays NULL
    assert seg_text["Medium (€50-200)"].fraud_loss == "€299.99"


def test_hour_does_not_wrap_after_second_day(spark):
    data = make_data(spark, [(1, 172800, 5), (2, 90000, 5)], [(1, False), (2, False)])
    hours = {r.hour_of_day for r in views.fraud_hourly_stats(data).collect()}
    assert hours == {24, 1}


def test_constant_feature_gives_null_z_and_no_flags(spark):
    rows = [(i, i, 10, 1, 1, 1, 1, 1) for i in range(30)]
    data = make_data(spark, rows, [(i, i % 2 == 0) for i in range(30)])
    sweep = detect.zscore_threshold_sweep(data).collect()
    assert all(r.flagged_transactions == 0 and r.precision_percentage is None for r in sweep)
    assert views.high_risk_transactions(data, include_timestamp=False).count() == 0


def test_method_flagging_nothing_sorts_first_with_null_precision(spark):
    # no pattern amount, no V3 spike: the pattern method flags nothing
    rows = [(i, i, 10 + i, 0, 0, (i % 7) * 0.1) for i in range(40)]
    data = make_data(spark, rows, [(i, i % 5 == 0) for i in range(40)])
    out = detect.method_comparison(data).collect()
    assert out[0].precision_percentage is None and out[0].total_flagged == 0


def test_pattern_needs_enough_rows_for_z_above_15(spark):
    # the largest z a sample of n rows allows is (n-1)/sqrt(n)
    n = 300
    rows = [(i, i, "99.99" if i == 0 else 20, 0, 0, 1 if i == 0 else 0) for i in range(n)]
    data = make_data(spark, rows, [(i, i == 0) for i in range(n)])
    top = detect.v3_pattern_top(data).collect()
    assert len(top) == 1 and top[0].fraud_action == "IMMEDIATE_BLOCK"
    assert top[0].v3_zscore == Decimal(str(round((n - 1) / math.sqrt(n), 2)))
    small = make_data(spark, rows[:200], [(i, i == 0) for i in range(200)])
    assert detect.v3_pattern_top(small).collect()[0].fraud_action != "IMMEDIATE_BLOCK"


def test_percent_rank_among_flagged_rows_only(spark):
    # nine rows, one outlier: it is the only flagged row, so its rank is 0
    rows = [(i, i, 1000 if i == 0 else 10 + i, 0) for i in range(9)]
    data = make_data(spark, rows, [(i, False) for i in range(9)])
    out = detect.amount_flagged_top(data).collect()
    assert len(out) == 1 and out[0].amount_percentile == Decimal("0.00")


def test_percent_rank_matches_brute_force(spark):
    from ledgerlens.operators.topk import top_k, with_percent_rank_of_top

    vals = [5, 5, 7, 9, 9, 9, 12, 15, 15, 20, 3, 1]
    df = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate(vals)], "id long, amount decimal(10,2)")
    top = top_k(df, [F.col("amount").desc(), F.col("id")], 5)
    got = {r.id: r.pr for r in with_percent_rank_of_top(df, top, "amount", "pr").collect()}
    n = len(vals)
    for i, pr in got.items():
        below = sum(1 for v in vals if v < vals[i])
        assert pr == (Decimal(below * 100) / Decimal(n - 1)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    assert len(got) == 5


def test_empty_input(spark):
    data = make_data(spark, [], [])
    ov = {r.metric: r for r in detect.fraud_overview(data).collect()}
    assert ov["Fraud Cases"]["count"] == 0 and ov["Fraud Cases"].percentage is None
    assert views.fraud_hourly_stats(data).count() == 0
    dash = views.executive_dashboard(data, include_timestamp=False).collect()[0]
    assert dash.total_transactions == 0 and dash.total_volume is None and dash.fraud_rate is None


def test_dominant_feature_ties_take_the_first(spark):
    from ledgerlens.plans.detect import outlier_scores

    # v2 and v4 share the largest deviation on row 0: the first (V2) wins
    rows = [(0, 0, 10, 0, 40, 0, 40, 0)] + [(i, i, 10, 0, (i % 3) - 1, 0, (i % 3) - 1, 0) for i in range(1, 60)]
    data = make_data(spark, rows, [(i, False) for i in range(60)])
    r = outlier_scores(data).where("transaction_id = 0").collect()[0]
    assert r.dominant_outlier_feature == "V2_dominant"


def test_two_contradicting_cases_count_twice(spark):
    data = make_data(spark, [(1, 0, 10), (2, 0, 20)], [(1, True), (1, False), (2, False)])
    dash = views.executive_dashboard(data, include_timestamp=False).collect()[0]
    assert dash.total_transactions == 3 and dash.fraud_cases == 1


def test_narrow_labelled_equals_the_join(spark):
    from payment_helpers import SF_SMALL
    from ledgerlens.operators.labelled import labelled as join_labelled
    from ledgerlens.plans.data import PaymentData

    data = PaymentData.derive_from_testdata(spark, SF_SMALL)
    joined = join_labelled(data.transactions, data.fraud_cases)
    narrow = data.labelled.select(*joined.columns)
    assert narrow.count() == joined.count() == 1001
    assert narrow.exceptAll(joined).count() == 0 and joined.exceptAll(narrow).count() == 0


def test_time_after_second_day_is_night(spark):
    data = make_data(spark, [(1, 172800, 5), (2, -5, 5)], [(1, False), (2, False)])
    got = {r.transaction_id: r.p for r in data.labelled.select(
        "transaction_id", bands.time_period_rank(F.col("transaction_time")).alias("p")).collect()}
    assert got == {1: 6, 2: 6}


def test_single_row(spark):
    from ledgerlens.operators.topk import with_percent_rank_of_top

    data = make_data(spark, [(1, 10, 50, 1, 1, 1, 1, 1)], [(1, True)])
    out = detect.method_comparison(data).collect()
    assert all(r.total_flagged == 0 and r.precision_percentage is None for r in out)
    assert {r.recall_percentage for r in out} == {Decimal("0.00")}
    one = spark.createDataFrame([(7, Decimal("3.00"))], "id long, amount decimal(10,2)")
    ranked = with_percent_rank_of_top(one, one, "amount", "pr").collect()
    assert ranked[0].pr == Decimal("0.00")


def test_exact_percentiles_match_linear_interpolation(spark):
    import numpy as np

    from ledgerlens.operators.quantiles import exact_percentiles

    vals = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4]
    df = spark.createDataFrame([(Decimal(v) / 4,) for v in vals] + [(None,)], "amount decimal(10,2)")
    got = exact_percentiles(df, "amount", [("p95", Decimal("0.95")), ("p50", Decimal("0.5"))]).collect()[0]
    arr = np.array([v / 4 for v in vals])
    assert float(got.p95) == float(np.percentile(arr, 95)) and float(got.p50) == float(np.percentile(arr, 50))
    empty = exact_percentiles(df.where("amount > 100"), "amount", [("p95", Decimal("0.95"))]).collect()
    assert empty[0].p95 is None


def test_amount_method_catching_nothing_has_zero_not_null_precision(spark):
    from payment_helpers import SF_SMALL
    from ledgerlens.plans.data import PaymentData

    rows = {r.detection_method: r for r in detect.method_comparison(PaymentData.from_testdata(spark, SF_SMALL)).collect()}
    amount = rows["Amount-Based (2.5x StdDev)"]
    assert (amount.total_flagged, amount.fraud_caught) == (14, 0)
    assert amount.precision_percentage == Decimal("0.00")
