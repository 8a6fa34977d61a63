"""Fixed values that results must reproduce exactly.

Everything in this module is a fixed value: labels, band limits, thresholds
and report texts as the analytics define them. They are kept together, in
the order in which the reports print them, and are passed to the jobs as
default parameters so that a user can change them without touching a job.
"""

from decimal import Decimal

# --- fixed values: currency and seconds ---------------------------------
CURRENCY = "€"
SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600
OBSERVED_HOURS = 48  # the transaction file spans two days

# --- fixed values: detectors ---------------------------------------------
AMOUNT_SD_MULTIPLIERS = (1.0, 1.5, 2.0, 2.5, 3.0)
AMOUNT_SWEEP_LABELS = ("1.0x StdDev", "1.5x StdDev", "2.0x StdDev", "2.5x StdDev", "3.0x StdDev")
ZSCORE_THRESHOLDS = (1.0, 1.5, 2.0, 2.5, 3.0)
ZSCORE_SWEEP_LABELS = ("Z-score > 1.0", "Z-score > 1.5", "Z-score > 2.0", "Z-score > 2.5", "Z-score > 3.0")
ZSCORE_FEATURES = ("v1", "v2", "v3", "v4", "v5")
OPTIMAL_AMOUNT_MULTIPLIER = 2.5
OUTLIER_AVG_Z = 3.0
STATISTICAL_V3_Z = 3.0
PATTERN_V3_Z = 15.0
REVIEW_V3_Z = 12.0
REVIEW_MAX_AMOUNT = Decimal("10")
MONITOR_V3_Z = 10.0
PATTERN_AMOUNTS = (Decimal("1"), Decimal("99.99"), Decimal("0.01"))

# --- fixed values: actions and classifications ----------------------------
ACTION_BLOCK = "IMMEDIATE_BLOCK"
ACTION_REVIEW = "HIGH_PRIORITY_REVIEW"
ACTION_MONITOR = "MONITOR_CLOSELY"
ACTION_NORMAL = "NORMAL_PROCESSING"
REVIEW_PRIORITY_HIGH = "HIGH_PRIORITY_REVIEW"
REVIEW_PRIORITY_NORMAL = "NORMAL_MONITORING"
OUTLIER_LABEL = "STATISTICAL_OUTLIER"
NORMAL_PATTERN_LABEL = "NORMAL_PATTERN"
DOMINANT_LABELS = ("V1_dominant", "V2_dominant", "V3_dominant", "V4_dominant", "V5_dominant")
PATTERN_METHOD_TAG = "V3_Pattern_Based"

# --- fixed values: method comparison labels and notes --------------------
METHOD_LABELS_LONG = ("Amount-Based (2.5x StdDev)", "Statistical Outlier (Z-score > 3.0)", "V3 Pattern-Based (Advanced)")
METHOD_LABELS_SHORT = ("Amount-Based", "Statistical Outlier", "V3 Pattern-Based")
METHOD_NOTES = (
    "Low precision, high false positives",
    "Moderate precision, manageable workload",
    "Highest precision, optimal for production",
)

# --- fixed values: overview rows ------------------------------------------
OVERVIEW_METRICS = ("Total Transactions", "Fraud Cases", "Normal Cases")
OVERVIEW_TOTAL_PERCENT = "100.00%"

# --- fixed values: amount segments (upper limits inclusive) ---------------
SEGMENT_LIMITS = (Decimal("10"), Decimal("50"), Decimal("200"), Decimal("1000"))
SEGMENT_LABELS = ("Micro (≤€10)", "Small (€10-50)", "Medium (€50-200)", "Large (€200-1000)", "Premium (>€1000)")
SEGMENT_SHORT_LABELS = ("Micro", "Small", "Medium", "Large", "Premium")

# --- fixed values: four-hour periods (inclusive second ranges, two days) --
PERIOD_LABELS = (
    "Early Morning (00:00-03:59)",
    "Morning (04:00-07:59)",
    "Business Hours (08:00-11:59)",
    "Afternoon (12:00-15:59)",
    "Evening (16:00-19:59)",
    "Night (20:00-23:59)",
)
PERIOD_SECONDS = 14400
PERIOD_FOLDED_DAYS = 2  # day 1 and day 2 are folded; anything else is 'Night'

# --- fixed values: value bands (upper limits inclusive) -------------------
VALUE_BAND_LIMITS = (Decimal("50"), Decimal("500"))
VALUE_BAND_LABELS = ("Low Value", "Medium Value", "High Value")

# --- fixed values: executive summary rows ---------------------------------
SUMMARY_ROWS = (
    ("TRANSACTION OVERVIEW", "Total Transactions Processed"),
    ("FRAUD OVERVIEW", "Total Fraud Cases Detected"),
    ("FINANCIAL IMPACT", "Total Transaction Volume (EUR)"),
    ("FINANCIAL IMPACT", "Fraud Loss Amount (EUR)"),
    ("OPERATIONAL EFFICIENCY", "Average Transaction Amount (EUR)"),
)
SUMMARY_FULL_BENCHMARK = "100%"
SUMMARY_AVERAGE_BENCHMARK = "Industry Benchmark"

# --- fixed values: financial impact rows ----------------------------------
IMPACT_ROWS = (
    ("FRAUD FINANCIAL IMPACT", "Total Fraud Loss"),
    ("FRAUD FINANCIAL IMPACT", "Average Fraud Transaction"),
    ("FRAUD FINANCIAL IMPACT", "Fraud Loss per Hour"),
    ("BUSINESS PERFORMANCE", "Fraud Detection Rate"),
    ("DETECTION EFFECTIVENESS", "V3 Method Precision"),
)
IMPACT_VS_AVG_SUFFIX = "% vs avg transaction"
IMPACT_PER_HOUR_NOTE = "2-day period average"
IMPACT_RATE_NOTE = "Industry benchmark: {}%"
IMPACT_PRECISION_NOTE = "Best performing method"
PUBLISHED_V3_PRECISION_TEXT = "89.66%"

# --- fixed values: operational insights -----------------------------------
INSIGHT_CATEGORY_OPS = "OPERATIONAL RECOMMENDATIONS"
INSIGHT_CATEGORY_BENCH = "PERFORMANCE BENCHMARKS"
INSIGHT_TYPES = (
    "Peak Risk Hours",
    "Transaction Segments",
    "Detection Method",
    "Alert Thresholds",
    "Fraud Rate vs Industry",
    "Financial Impact",
)
INSIGHT_ACTIONS = (
    " fraud rate - Increase monitoring staff",
    " fraud rate - Enhanced screening protocols",
    " precision - Deploy for real-time monitoring",
)
INSIGHT_ALERT_TIMEFRAME = "V3 Z-score > 15"
INSIGHT_ALERT_ACTION = "Immediate block for amounts €1, €99.99, €0.01"
INSIGHT_NO_DATA = "n/a"
INDUSTRY_BENCHMARK_PCT = Decimal("0.5")
PEAK_WINDOW_HOURS = 2

# --- fixed values: load metadata ------------------------------------------
LABEL_METHOD = "kaggle_labeled"
FRAUD_PROBABILITY = Decimal("0.95")
NORMAL_PROBABILITY = Decimal("0.05")
VALIDATION_ROWS = (
    ("staging.raw_creditcard", "Source data"),
    ("analytics.transactions", "Main transaction table"),
    ("fraud_detection.fraud_cases", "Fraud classification table"),
)
TEST_LOAD_TIME = "2024-01-01 00:00:00"  # of the registered queries, so that loads repeat
N_FEATURES = 28
DEFAULT_RISK_SCORE = 50
