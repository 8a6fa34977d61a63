"""Detection analyses: overview, threshold sweeps, flagged top-k lists and the
comparison of detection methods.

Every whole-table statistic is one global aggregate broadcast as a single
row (``operators.stats``); every multi-threshold or multi-method table is one
conditional-aggregate pass (``operators.sweep``); every ranked list is a
TakeOrderedAndProject top-k. No plan here moves fact rows to one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.numeric import cents, half_up_ratio, half_up_round, pct_text
from ..operators.reshape import rows_from_one
from ..operators.stats import column_stats, mean_col, sd_col, with_stats, zscore
from ..operators.sweep import confusion_sweep, precision_pct
from ..operators.ranks import with_percent_ranks
from ..operators.topk import top_k, with_percent_rank_of_top
from .data import PaymentData



def _amount_threshold(k: float) -> Column:
    return F.col(mean_col("amount")) + F.lit(k) * F.col(sd_col("amount"))


def _amount_flag(k: float) -> Column:
    return F.col("amount").cast("double") > _amount_threshold(k)


def pattern_flag(z3: Column, amount: Column, z: float = C.PATTERN_V3_Z,
                 amounts: Sequence = C.PATTERN_AMOUNTS) -> Column:
    return (z3 > F.lit(z)) & amount.isin(*[F.lit(a) for a in amounts])


def pattern_action(z3: Column, amount: Column) -> Column:
    """First match wins: block the pattern amounts at very high V3 z, review
    small amounts at high z, monitor the rest above the watch line."""
    return (
        F.when(pattern_flag(z3, amount), C.ACTION_BLOCK)
        .when((z3 > F.lit(C.REVIEW_V3_Z)) & (amount < F.lit(C.REVIEW_MAX_AMOUNT)), C.ACTION_REVIEW)
        .when(z3 > F.lit(C.MONITOR_V3_Z), C.ACTION_MONITOR)
        .otherwise(C.ACTION_NORMAL)
    )


def _precision_order(df: DataFrame, col: str = "precision_percentage") -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_first(), F.col("detector_order"))


# --- P09 -------------------------------------------------------------------
def fraud_overview(data: PaymentData) -> DataFrame:
    """Three rows (total, fraud, normal) over the fraud-case table, with the
    share of all cases as text. One aggregate, one scan."""
    one = data.fraud_cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_fraud")).alias("nf"),
        F.count_if(~F.col("is_fraud")).alias("nn"),
    )
    share = lambda c: pct_text(half_up_ratio(F.col(c), F.col("n"), 3, factor=100))
    total, fraud, normal = C.OVERVIEW_METRICS
    return rows_from_one(one, ["metric", "count", "percentage"], [
        (total, F.col("n"), C.OVERVIEW_TOTAL_PERCENT),
        (fraud, F.col("nf"), share("nf")),
        (normal, F.col("nn"), share("nn")),
    ])


# --- P10 -------------------------------------------------------------------
def amount_threshold_sweep(
    data: PaymentData,
    multipliers: Sequence[float] = C.AMOUNT_SD_MULTIPLIERS,
    labels: Sequence[str] = C.AMOUNT_SWEEP_LABELS,
) -> DataFrame:
    """flagged = amount > mean + k·sd (sample sd over labelled rows) for each k;
    precision NULL when nothing is flagged; highest precision first."""
    fact = data.labelled.select("amount", "is_fraud")
    scored = with_stats(fact, column_stats(fact, ["amount"]))
    sweep = confusion_sweep(scored, [(lab, _amount_flag(k)) for lab, k in zip(labels, multipliers)], F.col("is_fraud"),
                            "threshold_type")
    out = sweep.select(
        "threshold_type",
        F.col("flagged").alias("flagged_transactions"),
        F.col("caught").alias("fraud_caught"),
        precision_pct(F.col("caught"), F.col("flagged")).alias("precision_percentage"),
        "detector_order",
    )
    return _precision_order(out).drop("detector_order")


# --- P11 -------------------------------------------------------------------
def amount_flagged_top(data: PaymentData, multiplier: float = C.OPTIMAL_AMOUNT_MULTIPLIER, limit: int = 50) -> DataFrame:
    """The largest flagged amounts with the average, the threshold, and each
    row's percent rank (x100) among *all flagged rows* (the rank is taken after
    the threshold filter and before the limit)."""
    fact = data.labelled.select("transaction_id", "amount", "is_fraud")
    stats = column_stats(fact, ["amount"], F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_cnt"))
    scored = with_stats(fact, stats)
    # ``_cnt > 0`` and a non-NULL ``_sum`` hold for every row that can be
    # flagged; referencing them keeps the statistics aggregate identical in
    # both branches below (the rank counts would otherwise prune it to
    # mean/sd), so its exchange is computed once
    flagged = scored.where(_amount_flag(multiplier) & (F.col("_cnt") > 0) & F.col("_sum").isNotNull())
    order = [F.col("amount").desc_nulls_first(), F.col("transaction_id").asc_nulls_last(), F.col("is_fraud").asc_nulls_last()]
    top = top_k(flagged, order, limit)
    ranked = with_percent_rank_of_top(flagged.select("amount"), top, "amount", "amount_percentile")
    avg2 = half_up_ratio(cents(F.col("_sum")), F.col("_cnt") * 100, 2)
    out = ranked.select(
        "transaction_id",
        "amount",
        "is_fraud",
        avg2.alias("avg_amount"),
        half_up_round(_amount_threshold(multiplier), 2).alias("optimal_threshold"),
        F.when(_amount_flag(multiplier), C.REVIEW_PRIORITY_HIGH).otherwise(C.REVIEW_PRIORITY_NORMAL).alias("review_priority"),
        "amount_percentile",
    )
    return out.orderBy(*order)


def amount_flagged_ranked(data: PaymentData, multiplier: float = C.OPTIMAL_AMOUNT_MULTIPLIER) -> DataFrame:
    """Every flagged row with its percent rank (x100) among all flagged rows, by a distributed rank."""
    fact = data.labelled.select("transaction_id", "amount", "is_fraud")
    scored = with_stats(fact, column_stats(fact, ["amount"], F.sum("amount").alias("_sum"), F.count(F.lit(1)).alias("_cnt")))
    flagged = scored.where(_amount_flag(multiplier)).select(
        "transaction_id", "amount", "is_fraud", half_up_ratio(cents(F.col("_sum")), F.col("_cnt") * 100, 2).alias("avg_amount"),
        half_up_round(_amount_threshold(multiplier), 2).alias("optimal_threshold"), F.lit(C.REVIEW_PRIORITY_HIGH).alias("review_priority"))
    return with_percent_ranks(flagged, "amount", "amount_percentile")


# --- z-score helpers ---------------------------------------------------------
def _zscored(fact: DataFrame, features: Sequence[str]) -> DataFrame:
    scored = with_stats(fact, column_stats(fact, features))
    return scored.withColumns({f"{f}_z": zscore(f) for f in features})


def _avg_z(features: Sequence[str]) -> Column:
    total = None
    for f in features:
        total = F.col(f"{f}_z") if total is None else total + F.col(f"{f}_z")
    return total / F.lit(float(len(features)))


# --- P13 -------------------------------------------------------------------
def zscore_threshold_sweep(
    data: PaymentData,
    thresholds: Sequence[float] = C.ZSCORE_THRESHOLDS,
    labels: Sequence[str] = C.ZSCORE_SWEEP_LABELS,
    features: Sequence[str] = C.ZSCORE_FEATURES,
) -> DataFrame:
    """flagged = mean of the five feature z-scores > t, for each t."""
    fact = data.labelled.select(*features, "is_fraud")
    scored = _zscored(fact, features).withColumn("avg_z", _avg_z(features))
    sweep = confusion_sweep(scored, [(lab, F.col("avg_z") > F.lit(t)) for lab, t in zip(labels, thresholds)], F.col("is_fraud"),
                            "threshold_type")
    out = sweep.select(
        "threshold_type",
        F.col("flagged").alias("flagged_transactions"),
        F.col("caught").alias("fraud_caught"),
        precision_pct(F.col("caught"), F.col("flagged")).alias("precision_percentage"),
        "detector_order",
    )
    return _precision_order(out).drop("detector_order")


# --- P14 -------------------------------------------------------------------
def outlier_scores(data: PaymentData, features: Sequence[str] = C.ZSCORE_FEATURES) -> DataFrame:
    """Labelled rows with each feature's z (``<f>_z``), their mean (``_avg_z``)
    and the dominant feature (the first whose z equals the largest)."""
    fact = data.labelled.select("transaction_id", "amount", "is_fraud", *features)
    scored = _zscored(fact, features).withColumn("_avg_z", _avg_z(features))
    zs = [F.col(f"{f}_z") for f in features]
    greatest = F.greatest(*zs)
    dominant = None
    for z, label in zip(zs[:-1], C.DOMINANT_LABELS):
        dominant = F.when(z == greatest, label) if dominant is None else dominant.when(z == greatest, label)
    dominant = dominant.otherwise(C.DOMINANT_LABELS[len(features) - 1])
    return scored.withColumn("dominant_outlier_feature", dominant)


def zscore_outliers_top(data: PaymentData, threshold: float = C.OUTLIER_AVG_Z, limit: int = 50,
                        features: Sequence[str] = C.ZSCORE_FEATURES) -> DataFrame:
    """Rows whose average z exceeds the threshold, frauds first, then by the
    rounded average z; with the dominant feature (first with the largest z)."""
    out = outlier_scores(data, features).where(F.col("_avg_z") > F.lit(threshold)).select(
        "transaction_id",
        "amount",
        "is_fraud",
        *[half_up_round(F.col(f"{f}_z"), 2).alias(f"{f}_zscore") for f in features],
        half_up_round(F.col("_avg_z"), 2).alias("avg_zscore"),
        F.when(F.col("_avg_z") > F.lit(threshold), C.OUTLIER_LABEL).otherwise(C.NORMAL_PATTERN_LABEL)
        .alias("outlier_classification"),
        "dominant_outlier_feature",
    )
    order = [F.col("is_fraud").desc_nulls_first(), F.col("avg_zscore").desc_nulls_first(),
             F.col("transaction_id").asc_nulls_last()]
    return top_k(out, order, limit)


# --- P15 -------------------------------------------------------------------
def v3_scored(data: PaymentData, extra: Sequence[str] = ()) -> DataFrame:
    """Labelled rows with ``v3_z`` over all labelled rows."""
    fact = data.labelled.select("transaction_id", "amount", "is_fraud", "v3", *extra)
    return with_stats(fact, column_stats(fact, ["v3"])).withColumn("v3_z", zscore("v3"))


def v3_pattern_top(data: PaymentData, watch_z: float = C.MONITOR_V3_Z, limit: int = 100) -> DataFrame:
    """Rows above the V3 watch line with the recommended action, highest
    (rounded) z first."""
    out = v3_scored(data).where(F.col("v3_z") > F.lit(watch_z)).select(
        "transaction_id",
        "amount",
        "is_fraud",
        half_up_round(F.col("v3_z"), 2).alias("v3_zscore"),
        pattern_action(F.col("v3_z"), F.col("amount")).alias("fraud_action"),
        F.lit(C.PATTERN_METHOD_TAG).alias("detection_method"),
    )
    order = [F.col("v3_zscore").desc_nulls_first(), F.col("transaction_id").asc_nulls_last(),
             F.col("is_fraud").asc_nulls_last()]
    return top_k(out, order, limit)


# --- P16 -------------------------------------------------------------------
def method_detectors(labels: Sequence[str] = C.METHOD_LABELS_LONG) -> list[tuple[str, Column]]:
    """The three detectors over rows with their ``v3_z`` and the statistics:
    amount > mean + 2.5 sd, V3 z > 3, and the V3 pattern (z > 15 and a pattern amount)."""
    return [
        (labels[0], _amount_flag(C.OPTIMAL_AMOUNT_MULTIPLIER)),
        (labels[1], F.col("v3_z") > F.lit(C.STATISTICAL_V3_Z)),
        (labels[2], pattern_flag(F.col("v3_z"), F.col("amount"))),
    ]


def method_sweep(data: PaymentData, labels: Sequence[str] = C.METHOD_LABELS_LONG) -> DataFrame:
    """Counts of the three detectors in one pass."""
    fact = data.labelled.select("amount", "v3", "is_fraud")
    scored = with_stats(fact, column_stats(fact, ["amount", "v3"])).withColumn("v3_z", zscore("v3"))
    return confusion_sweep(scored, method_detectors(labels), F.col("is_fraud"), "detection_method")


def method_comparison(data: PaymentData) -> DataFrame:
    """Precision (NULL when a method flags nothing) and recall against all
    fraud cases flagged TRUE, highest precision first."""
    sweep = method_sweep(data).crossJoin(F.broadcast(data.fraud_case_count()))
    out = sweep.select(
        "detection_method",
        F.col("flagged").alias("total_flagged"),
        F.col("caught").alias("fraud_caught"),
        "false_positives",
        precision_pct(F.col("caught"), F.col("flagged")).alias("precision_percentage"),
        half_up_ratio(F.col("caught"), F.col("n_fraud_cases"), 2, factor=100).alias("recall_percentage"),
        "detector_order",
    )
    return _precision_order(out).drop("detector_order")


def detector_extras(data: PaymentData) -> DataFrame:
    """Method comparison plus the share of flagged rows that are not fraud and
    the review workload saved against the method flagging the most rows."""
    base = method_comparison(data)
    # a window over the three result rows, not a second pass over the fact
    most = F.max("total_flagged").over(Window.partitionBy())
    return base.withColumn("_most", most).select(
        *base.columns,
        half_up_ratio(F.col("false_positives"), F.col("total_flagged"), 2, factor=100).alias("false_discovery_percentage"),
        half_up_ratio(F.col("_most") - F.col("total_flagged"), F.col("_most"), 2, factor=100)
        .alias("workload_reduction_percentage"),
    )
