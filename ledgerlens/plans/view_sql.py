"""The five operational views as SQL text: the one definition of each.

A text names two relations: ``{labelled}``, every transaction with each of its
cases, and ``{cases}``, the fraud cases. The DataFrame form of a view
(``views.py``) runs the text over a ``PaymentData``; the stored form
(``catalog.create_views``) puts the published tables in their place and keeps
the text in the catalog, so both always give the same rows.

Ratios are the exact half-up division of ``functions.numeric.half_up_ratio``;
statistics of all rows are one-row subqueries that are broadcast, never
windows without a partition.
"""

from __future__ import annotations

from .. import constants as C


def text(value) -> str:
    """A SQL string literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ratio(part: str, whole: str, places: int, factor: int = 1) -> str:
    """``part * factor / whole`` rounded half away from zero; NULL where whole is 0 or NULL. Operands are integral."""
    n, d = f"CAST({part} AS DECIMAL(38,0))", f"CAST({whole} AS DECIMAL(38,0))"
    magnitude = f"((abs({n}) * {2 * factor * 10 ** places} + abs({d})) DIV (abs({d}) * 2))"
    signed = f"CASE WHEN signum({n}) * signum({d}) < 0 THEN -{magnitude} ELSE {magnitude} END"
    return f"CASE WHEN {d} <> 0 THEN CAST(CAST({signed} AS DECIMAL(38,0)) * {1 / 10 ** places:.{places}f} AS DECIMAL(18,{places})) END"


def percent(part: str, whole: str, places: int) -> str:
    return ratio(part, whole, places, 100)


def cents(money: str) -> str:
    return f"{money} * 100"


def stamp(as_of) -> str:
    return "current_timestamp()" if as_of is None else f"CAST({text(as_of)} AS TIMESTAMP)"


def case(arms, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in arms) + f" ELSE {otherwise} END"


HOUR = (f"CAST(CASE WHEN transaction_time < {C.SECONDS_PER_DAY} THEN transaction_time ELSE transaction_time - {C.SECONDS_PER_DAY} END"
        f" DIV {C.SECONDS_PER_HOUR} AS INT)")
_PATTERN = f"amount IN ({', '.join(map(str, C.PATTERN_AMOUNTS))})"
ACTION = case([(f"v3_z > {C.PATTERN_V3_Z}D AND {_PATTERN}", text(C.ACTION_BLOCK)),
               (f"v3_z > {C.REVIEW_V3_Z}D AND amount < {C.REVIEW_MAX_AMOUNT}", text(C.ACTION_REVIEW)),
               (f"v3_z > {C.MONITOR_V3_Z}D", text(C.ACTION_MONITOR))], text(C.ACTION_NORMAL))


def _with_statistics(columns: str, *measures: str) -> str:
    """Labelled rows with mean and sample deviation of the measures; ``v3_z`` is the distance of V3 in deviations."""
    stats = ", ".join(f"avg(CAST({m} AS DOUBLE)) AS {m}_mean, stddev_samp(CAST({m} AS DOUBLE)) AS {m}_sd" for m in measures)
    return (f"(SELECT /*+ BROADCAST(centre) */ {columns}, amount, v3, is_fraud, {', '.join(f'{m}_mean, {m}_sd' for m in measures)}, "
            f"abs(CAST(v3 AS DOUBLE) - v3_mean) / nullif(v3_sd, 0.0D) AS v3_z "
            f"FROM {{labelled}} AS fact CROSS JOIN (SELECT {stats} FROM {{labelled}} AS every) AS centre)")


HOURS = (f"(SELECT {HOUR} AS hour_of_day, count(*) AS total_transactions, count_if(is_fraud) AS fraud_count, "
         f"count_if(NOT is_fraud) AS normal_count FROM {{labelled}} AS fact GROUP BY 1)")
KNOWN = "(SELECT count_if(is_fraud) AS n_fraud_cases FROM {cases} AS filed)"


def fraud_hourly_stats(as_of=None, include_timestamp: bool = True, hours: str = HOURS, known: str = KNOWN) -> str:
    """``hours`` and ``known`` are the counts, of the fact or merged from partial counts (``view_state.py``)."""
    return f"""
SELECT /*+ BROADCAST(known) */ hour_of_day, total_transactions, fraud_count, normal_count,
  {percent('fraud_count', 'total_transactions', 3)} AS fraud_rate_percentage,
  {percent('fraud_count', 'n_fraud_cases', 1)} AS fraud_distribution_percentage
FROM {hours} AS hours CROSS JOIN {known} AS known"""


def high_risk_transactions(as_of=None, include_timestamp: bool = True, watch_z: float = C.MONITOR_V3_Z) -> str:
    return f"""
SELECT transaction_id, amount, is_fraud, CAST(round(CAST(v3_z AS DECIMAL(38,12)), 2) AS DECIMAL(18,2)) AS v3_risk_score,
  {ACTION} AS recommended_action{f', {stamp(as_of)} AS analysis_timestamp' if include_timestamp else ''}
FROM {_with_statistics('transaction_id', 'v3')} AS scored WHERE v3_z > {watch_z}D"""


def detection_performance_summary(as_of=None, include_timestamp: bool = True) -> str:
    flags = (f"CAST(amount AS DOUBLE) > amount_mean + {C.OPTIMAL_AMOUNT_MULTIPLIER}D * amount_sd", f"v3_z > {C.STATISTICAL_V3_Z}D",
             f"v3_z > {C.PATTERN_V3_Z}D AND {_PATTERN}")
    counts = ", ".join(f"count_if({f}) AS flagged{i}, count_if(({f}) AND is_fraud) AS caught{i}" for i, f in enumerate(flags))
    rows = ", ".join(f"named_struct('detection_method', {text(label)}, 'flagged', flagged{i}, 'caught', caught{i}, 'note', {text(note)})"
                     for i, (label, note) in enumerate(zip(C.METHOD_LABELS_SHORT, C.METHOD_NOTES)))
    return f"""
SELECT detection_method, flagged AS total_flagged, caught AS fraud_caught,
  {percent('caught', 'flagged', 2)} AS precision_percentage, note AS performance_note
FROM (SELECT inline(array({rows}))
      FROM (SELECT {counts} FROM {_with_statistics('transaction_id', 'amount', 'v3')} AS scored) AS once) AS hits"""


TOTALS = ("(SELECT count(*) AS total_transactions, count_if(is_fraud) AS fraud_cases, sum(amount) AS total_volume, "
          "sum(CASE WHEN is_fraud THEN amount END) AS fraud_loss, avg(amount) AS avg_transaction FROM {labelled} AS fact)")


def executive_dashboard(as_of=None, include_timestamp: bool = True, totals: str = TOTALS) -> str:
    return f"""
SELECT total_transactions, fraud_cases, {percent('fraud_cases', 'total_transactions', 3)} AS fraud_rate, total_volume, fraud_loss,
  {percent(cents('fraud_loss'), cents('total_volume'), 4)} AS loss_percentage, avg_transaction{f', {stamp(as_of)} AS report_timestamp' if include_timestamp else ''}
FROM {totals} AS totals"""


PLACE = case([(f"amount <= {x}", str(i + 1)) for i, x in enumerate(C.SEGMENT_LIMITS)], str(len(C.SEGMENT_LIMITS) + 1))
BANDS = (f"(SELECT {PLACE} AS place, count(*) AS transactions, count_if(is_fraud) AS fraud_count, sum(amount) AS volume, "
         "sum(CASE WHEN is_fraud THEN amount END) AS fraud_volume FROM {labelled} AS fact GROUP BY 1)")


def segment_performance(as_of=None, include_timestamp: bool = True, bands: str = BANDS) -> str:
    label = case([(f"place = {i + 1}", text(x)) for i, x in enumerate(C.SEGMENT_SHORT_LABELS[:-1])], text(C.SEGMENT_SHORT_LABELS[-1]))
    return f"""
SELECT {label} AS segment, transactions, fraud_count, {percent('fraud_count', 'transactions', 3)} AS fraud_rate, volume, fraud_volume,
  {percent(cents('fraud_volume'), cents('volume'), 4)} AS loss_rate{f', {stamp(as_of)} AS report_timestamp' if include_timestamp else ''}
FROM {bands} AS bands
ORDER BY volume DESC NULLS FIRST, place"""


#: fixed value: the schema that holds the views
SCHEMA = "fraud_detection"
DEFINITIONS = {f.__name__: f for f in (fraud_hourly_stats, high_risk_transactions, detection_performance_summary,
                                       executive_dashboard, segment_performance)}
