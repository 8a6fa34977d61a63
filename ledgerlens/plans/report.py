"""Business reports: executive summary, hourly financials, financial impact,
amount segments, four-hour periods and operational insights.

Pattern: derive a band column, ``groupBy(band)`` with conditional counts and
sums (a handful of groups; partial aggregation absorbs any skew), then
compute ratios on the few result rows. Denominators over *all transactions*
come from one global aggregate of the transaction table; denominators over
the labelled rows come from a window over the few grouped rows, never from a
second pass over the fact. Multi-row text reports are one aggregate row
turned into rows with ``inline``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import (
    amount_segment_rank,
    hour_of_day,
    label_of_rank,
    time_period_rank,
    value_band_rank,
)
from ..functions.numeric import cents, half_up_ratio, money_grouped_text, money_text, pct_text
from ..operators.reshape import rows_from_one
from ..operators.stats import merged_stats, moments, with_stats, zscore
from ..operators.sweep import confusion_sweep, precision_pct
from .data import PaymentData
from .detect import method_detectors, pattern_flag, v3_scored



def _fraud_sum(c: str = "amount") -> Column:
    return F.sum(F.when(F.col("is_fraud"), F.col(c)))


def _avg2(sum_money: Column, n: Column) -> Column:
    """ROUND(AVG(money), 2) exactly: sum in cents / (n·100), half up."""
    return half_up_ratio(cents(sum_money), n * 100, 2)


# --- P21 -------------------------------------------------------------------
def executive_summary(data: PaymentData) -> DataFrame:
    """Five KPI rows. Count share and loss share use *all* transactions as
    denominator; fraud cases come from the case table, the loss from labelled
    fraud rows."""
    tot = data.transaction_totals()
    fcnt = data.fraud_case_count()
    loss = data.labelled.where(F.col("is_fraud")).agg(F.sum("amount").alias("fraud_loss"))
    one = tot.crossJoin(fcnt).crossJoin(loss)
    (c1, m1), (c2, m2), (c3, m3), (c4, m4), (c5, m5) = C.SUMMARY_ROWS
    rows = [
        (c1, m1, F.col("n_tx").cast("string"), C.SUMMARY_FULL_BENCHMARK),
        (c2, m2, F.col("n_fraud_cases").cast("string"),
         pct_text(half_up_ratio(F.col("n_fraud_cases"), F.col("n_tx"), 3, factor=100))),
        (c3, m3, money_grouped_text(F.col("volume_all")), C.SUMMARY_FULL_BENCHMARK),
        (c4, m4, money_grouped_text(F.col("fraud_loss")),
         pct_text(half_up_ratio(cents(F.col("fraud_loss")), F.col("volume_all_cents"), 3, factor=100))),
        (c5, m5, money_grouped_text(_avg2(F.col("volume_all"), F.col("n_tx"))), C.SUMMARY_AVERAGE_BENCHMARK),
    ]
    return rows_from_one(one, ["kpi_category", "metric", "value", "benchmark"], rows).orderBy("kpi_category", "metric")


# --- P22 -------------------------------------------------------------------
def hourly_financials(data: PaymentData) -> DataFrame:
    """Per hour: counts, rate, volume and fraud loss as currency text (an hour
    without fraud has NULL loss and NULL loss ratio); riskiest hours first."""
    g = (
        data.labelled.select(hour_of_day(F.col("transaction_time")).alias("hour_of_day"), "amount", "is_fraud")
        .groupBy("hour_of_day")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col("is_fraud")).alias("fraud_count"),
            F.sum("amount").alias("_volume"),
            _fraud_sum().alias("_fraud_volume"),
        )
    )
    out = g.select(
        "hour_of_day",
        "total_transactions",
        "fraud_count",
        half_up_ratio(F.col("fraud_count"), F.col("total_transactions"), 3, factor=100).alias("fraud_rate_percentage"),
        money_text(F.col("_volume"), 0).alias("hourly_volume"),
        money_text(F.col("_fraud_volume"), 2).alias("fraud_loss"),
        half_up_ratio(cents(F.col("_fraud_volume")), cents(F.col("_volume")), 4, factor=100)
        .alias("fraud_loss_ratio_percentage"),
    )
    return out.orderBy(F.col("fraud_rate_percentage").desc_nulls_first(), "hour_of_day")


# --- P23 -------------------------------------------------------------------
def financial_impact(data: PaymentData, hours: int = C.OBSERVED_HOURS, v3_precision_text: str | None = None,
                     benchmark_pct: Decimal = C.INDUSTRY_BENCHMARK_PCT) -> DataFrame:
    """Five rows of loss and rate figures. The V3 precision row is computed
    from the data unless a fixed text is given (the published text is
    ``constants.PUBLISHED_V3_PRECISION_TEXT``). The fraud totals and the
    pattern counts come from one aggregate over the labelled rows."""
    fraud = F.col("is_fraud")
    totals = [_fraud_sum().alias("fraud_loss"), F.count_if(fraud).alias("n_fraud")]
    if v3_precision_text is None:
        scored = v3_scored(data)
        flag = pattern_flag(F.col("v3_z"), F.col("amount"))
        one = scored.agg(*totals, F.count_if(flag).alias("_pf"), F.count_if(flag & fraud).alias("_pc"))
        precision_text = pct_text(half_up_ratio(F.col("_pc"), F.col("_pf"), 2, factor=100))
    else:
        one = data.labelled.agg(*totals)
        precision_text = F.lit(v3_precision_text)
    one = one.crossJoin(F.broadcast(data.transaction_totals()))
    loss_c = cents(F.col("fraud_loss"))
    (c1, m1), (c2, m2), (c3, m3), (c4, m4), (c5, m5) = C.IMPACT_ROWS
    rows = [
        (c1, m1, money_text(F.col("fraud_loss"), 2),
         pct_text(half_up_ratio(loss_c, F.col("volume_all_cents"), 4, factor=100))),
        (c2, m2, money_text(_avg2(F.col("fraud_loss"), F.col("n_fraud")), 2),
         pct_text(half_up_ratio(loss_c * F.col("n_tx"), F.col("n_fraud") * F.col("volume_all_cents"), 1, factor=100),
                  C.IMPACT_VS_AVG_SUFFIX)),
        (c3, m3, money_text(half_up_ratio(loss_c, F.lit(hours * 100), 2), 2), C.IMPACT_PER_HOUR_NOTE),
        (c4, m4, pct_text(half_up_ratio(F.col("n_fraud"), F.col("n_tx"), 3, factor=100)), C.IMPACT_RATE_NOTE.format(benchmark_pct)),
        (c5, m5, precision_text, C.IMPACT_PRECISION_NOTE),
    ]
    names = ["analysis_category", "metric", "value", "percentage_of_volume"]
    return rows_from_one(one, names, rows).orderBy("analysis_category", "metric")


# --- P24 -------------------------------------------------------------------
def _segment_groups(data: PaymentData) -> DataFrame:
    return (
        data.labelled.select(amount_segment_rank(F.col("amount")).alias("_rank"), "amount", "is_fraud")
        .groupBy("_rank")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col("is_fraud")).alias("fraud_transactions"),
            F.sum("amount").alias("_volume"),
            _fraud_sum().alias("_fraud_volume"),
        )
    )


def segment_analysis(data: PaymentData) -> DataFrame:
    """Five amount bands. Row share is of labelled rows; volume share is of
    the volume of *all* transactions."""
    g = _segment_groups(data)
    labelled_rows = F.sum("total_transactions").over(Window.partitionBy())  # over <= 5 grouped rows
    g = g.withColumn("_n_labelled", labelled_rows).crossJoin(F.broadcast(data.transaction_totals()))
    out = g.select(
        "_rank",
        label_of_rank(F.col("_rank"), C.SEGMENT_LABELS).alias("amount_segment"),
        "total_transactions",
        "fraud_transactions",
        half_up_ratio(F.col("fraud_transactions"), F.col("total_transactions"), 3, factor=100).alias("fraud_rate_percentage"),
        money_text(F.col("_volume"), 0).alias("segment_volume"),
        money_text(F.col("_fraud_volume"), 2).alias("fraud_loss"),
        half_up_ratio(cents(F.col("_fraud_volume")), cents(F.col("_volume")), 3, factor=100).alias("volume_loss_percentage"),
        money_text(_avg2(F.col("_volume"), F.col("total_transactions")), 2).alias("avg_transaction"),
        money_text(_avg2(F.col("_fraud_volume"), F.col("fraud_transactions")), 2).alias("avg_fraud_amount"),
        half_up_ratio(F.col("total_transactions"), F.col("_n_labelled"), 1, factor=100).alias("transaction_share_percentage"),
        half_up_ratio(cents(F.col("_volume")), F.col("volume_all_cents"), 1, factor=100).alias("volume_share_percentage"),
    )
    return out.orderBy("_rank").drop("_rank")


# --- P25 -------------------------------------------------------------------
def period_trends(data: PaymentData) -> DataFrame:
    """Six four-hour periods (day 1 and day 2 folded) with value-band shares
    and the fraud rate among high-value rows (0 when the period has none)."""
    band = F.col("_band")
    g = (
        data.labelled.select(
            time_period_rank(F.col("transaction_time")).alias("_rank"),
            value_band_rank(F.col("amount")).alias("_band"),
            "amount",
            "is_fraud",
        )
        .groupBy("_rank")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.count_if(F.col("is_fraud")).alias("fraud_count"),
            F.sum("amount").alias("_volume"),
            _fraud_sum().alias("_fraud_volume"),
            F.count_if(band == 1).alias("_low"),
            F.count_if(band == 2).alias("_medium"),
            F.count_if(band == 3).alias("_high"),
            F.count_if((band == 3) & F.col("is_fraud")).alias("high_value_fraud"),
        )
    )
    n = F.col("total_transactions")
    share = lambda c: half_up_ratio(F.col(c), n, 1, factor=100)
    out = g.select(
        "_rank",
        label_of_rank(F.col("_rank"), C.PERIOD_LABELS).alias("time_period"),
        "total_transactions",
        "fraud_count",
        half_up_ratio(F.col("fraud_count"), n, 3, factor=100).alias("fraud_rate_percentage"),
        money_text(F.col("_volume"), 0).alias("period_volume"),
        money_text(F.col("_fraud_volume"), 2).alias("fraud_loss"),
        money_text(_avg2(F.col("_volume"), n), 2).alias("avg_transaction"),
        share("_low").alias("low_value_percentage"),
        share("_medium").alias("medium_value_percentage"),
        share("_high").alias("high_value_percentage"),
        "high_value_fraud",
        F.when(F.col("_high") > 0, half_up_ratio(F.col("high_value_fraud"), F.col("_high"), 2, factor=100))
        .otherwise(F.lit(Decimal("0.00")).cast("decimal(18,2)")).alias("high_value_fraud_rate"),
    )
    return out.orderBy("_rank").drop("_rank")


# --- P26 -------------------------------------------------------------------
def _two_digit_hour(h: Column) -> Column:
    return F.concat(F.when(h.between(0, 9), "0").otherwise(""), h.cast("string"), F.lit(":00"))


def operational_insights(data: PaymentData, benchmark_pct: Decimal = C.INDUSTRY_BENCHMARK_PCT,
                         window_hours: int = C.PEAK_WINDOW_HOURS) -> DataFrame:
    """Six recommendation rows, computed from the data: the riskiest window of
    consecutive hours, the riskiest amount segment, the most precise method,
    the alert rule, and the fraud rate and loss share against an industry
    benchmark (a parameter). Two passes over the labelled rows (the methods need the
    statistics first), one over the transactions, four exchanges."""
    # first pass over the labelled rows: one (hour, segment) aggregate with counts, loss
    # and the moments of the scored columns; a few cells per hour, put into one partition,
    # where every roll-up below needs no further exchange
    cells = (
        data.labelled.select(hour_of_day(F.col("transaction_time")).alias("_h"),
                             amount_segment_rank(F.col("amount")).alias("_seg"), "amount", "v3", "is_fraud")
        .groupBy("_h", "_seg")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("is_fraud")).alias("_f"), _fraud_sum().alias("_loss"),
             moments("amount").alias("amount"), moments("v3").alias("v3"))
        .repartition(1)
    )
    # riskiest window of `window_hours` consecutive hours, all of them present, and riskiest segment
    w = Window.orderBy("_h").rangeBetween(0, window_hours - 1)
    by_segment = Window.partitionBy("_seg")
    rate_over = lambda over: half_up_ratio(F.sum("_f").over(over), F.sum("_n").over(over), 2, factor=100)
    rated = cells.select("*", F.size(F.collect_set("_h").over(w)).alias("_width"), rate_over(w).alias("_window_rate"),
                         rate_over(by_segment).alias("_segment_rate"))
    highest = lambda rate, then: F.struct((-F.col(rate)).alias("below"), F.col(then).alias("at"))
    found = merged_stats(
        rated, ["amount", "v3"], F.sum("_loss").alias("fraud_loss"), F.sum("_f").alias("n_fraud"),
        F.min(F.when((F.col("_width") == window_hours) & F.col("_h").isNotNull(), highest("_window_rate", "_h"))).alias("_peak"),
        F.min(highest("_segment_rate", "_seg")).alias("_worst"))
    # second pass: the methods, scored by that one row, which goes along with their counts
    scored = with_stats(data.labelled.select("amount", "v3", "is_fraud"), found).withColumn("v3_z", zscore("v3"))
    kept = ["fraud_loss", "n_fraud", "_peak", "_worst"]
    swept = confusion_sweep(scored, method_detectors(C.METHOD_LABELS_SHORT), F.col("is_fraud"), "detection_method", kept).withColumn(
        "_precision", precision_pct(F.col("caught"), F.col("flagged")))
    sharpest = F.min(F.when(F.col("_precision").isNotNull(), F.struct((-F.col("_precision")).alias("below"), "detector_order", "detection_method")))
    one = swept.agg(sharpest.alias("_best"), *[F.first(c).alias(c) for c in kept]).crossJoin(F.broadcast(data.transaction_totals()))
    one = one.withColumns({
        "_h0": _two_digit_hour(F.col("_peak.at")), "_h1": _two_digit_hour(F.col("_peak.at") + window_hours), "_peak_rate": -F.col("_peak.below"),
        "_segment": label_of_rank(F.col("_worst.at"), C.SEGMENT_LABELS), "_seg_rate": -F.col("_worst.below"),
        "_method": F.col("_best.detection_method"), "_precision": -F.col("_best.below")})
    # fraud rate and loss share against the benchmark (all transactions as base)
    exp = -benchmark_pct.as_tuple().exponent if benchmark_pct.as_tuple().exponent < 0 else 0
    b_int = int(benchmark_pct.scaleb(exp))
    scale = 10**exp
    rate = half_up_ratio(F.col("n_fraud"), F.col("n_tx"), 3, factor=100)
    loss_share = half_up_ratio(cents(F.col("fraud_loss")), F.col("volume_all_cents"), 3, factor=100)
    # (b - rate)/b·100 with rate = n_fraud·100/n_tx, in integers scaled by 10^exp
    better = half_up_ratio(F.lit(b_int) * F.col("n_tx") - F.col("n_fraud") * (100 * scale),
                           F.lit(b_int) * F.col("n_tx"), 0, factor=100)
    bench_txt = str(benchmark_pct)
    # where a part has no answer (no consecutive hours, no rows at all) its recommendation says so
    ops, bench = C.INSIGHT_CATEGORY_OPS, C.INSIGHT_CATEGORY_BENCH
    t = C.INSIGHT_TYPES
    none = F.lit(C.INSIGHT_NO_DATA)
    rows = [
        (ops, t[0], F.coalesce(F.concat(F.col("_h0"), F.lit("-"), F.col("_h1")), none),
         F.coalesce(F.concat(F.col("_peak_rate").cast("string"), F.lit("%" + C.INSIGHT_ACTIONS[0])), none)),
        (ops, t[1], F.coalesce(F.col("_segment"), none),
         F.coalesce(F.concat(F.col("_seg_rate").cast("string"), F.lit("%" + C.INSIGHT_ACTIONS[1])), none)),
        (ops, t[2], F.coalesce(F.col("_method"), none),
         F.coalesce(F.concat(F.col("_precision").cast("string"), F.lit("%" + C.INSIGHT_ACTIONS[2])), none)),
        (ops, t[3], C.INSIGHT_ALERT_TIMEFRAME, C.INSIGHT_ALERT_ACTION),
        (bench, t[4], F.concat(rate.cast("string"), F.lit(f"% vs {bench_txt}%")),
         F.when(better >= 0, F.concat(better.cast("string"), F.lit("% better than industry benchmark")))
         .otherwise(F.concat((-better).cast("string"), F.lit("% worse than industry benchmark")))),
        (bench, t[5], F.concat(loss_share.cast("string"), F.lit("% of volume")),
         F.when(loss_share < F.lit(benchmark_pct), F.lit(f"Well below industry average of {bench_txt}%+"))
         .otherwise(F.lit(f"Above industry average of {bench_txt}%+"))),
    ]
    names = ["category", "recommendation_type", "timeframe", "action_required"]
    return rows_from_one(one, names, rows).orderBy("category", "recommendation_type")
