"""DuckDB SQL for every registered query, derived from the result definitions.

Written independently of the Spark jobs, around three relations:

* ``payment``, ``verdict``: the fixture tables, by the rules of FIXTURES.md;
* ``gauged``: every payment with each of its verdicts, the distances of its
  features from their centre, and the keys of the fixed band tables;
* small VALUES tables made from the fixed values (detectors, amount segments,
  day periods, action rules), joined to the data instead of being spelled out
  as conditions.

A detector report is one grouped join of ``gauged`` with its detector table; a
report of fixed lines unnests a list of records over one row of totals.

Ratios are rounded half up on the exact integer quotient (``ratio``), because
a DOUBLE quotient misses some ties.
"""

from __future__ import annotations

import re

from ledgerlens import constants as C

# --- small generators -----------------------------------------------------------


def lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def table(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def ratio(part: str, whole: str, places: int, times: int = 1) -> str:
    """part * times / whole rounded half away from zero to ``places``; NULL if whole is 0 or either is NULL."""
    unit = 10**places
    magnitude = f"((2 * {times * unit} * abs({part})::HUGEINT + ({whole})::HUGEINT) // (2 * ({whole})::HUGEINT))"
    step = f"CAST({1 / unit:.{places}f} AS DECIMAL({places + 1},{places}))" if places else "1"
    return (f"CASE WHEN ({whole}) <> 0 THEN CAST(sign({part})::INT * CAST({magnitude} AS DECIMAL(30,0)) * {step} "
            f"AS DECIMAL(18,{places})) END")


def percent(part: str, whole: str, places: int) -> str:
    return ratio(part, whole, places, 100)


def cent(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def mean_money(total: str, n: str, places: int = 2) -> str:
    return ratio(cent(total), f"({n}) * 100", places)


def rounded(x: str, places: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {places}) AS DECIMAL(18,{places}))"


def euro(x: str) -> str:
    return f"'{C.CURRENCY}' || CAST({x} AS VARCHAR)"


def euro_grouped(x: str) -> str:
    return f"'{C.CURRENCY}' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def text(x: str, after: str = "%") -> str:
    return f"CAST({x} AS VARCHAR) || '{after}'"


def lines(columns: tuple[str, ...], rows, source: str) -> str:
    """A report of fixed lines over the one row of ``source``."""
    records = ", ".join("{" + ", ".join(f"'{c}': CAST({e} AS VARCHAR)" for c, e in zip(columns, r)) + "}" for r in rows)
    return f"SELECT unnest([{records}], recursive := true) FROM {source}"


# --- the fixture ------------------------------------------------------------------


def feature(multiplier: int) -> str:
    return f"CAST((event_id * {multiplier}) % 2001 - 1000 AS DECIMAL(10,6)) * CAST(0.001 AS DECIMAL(4,3))"


def feature_with(multiplier: int, special: dict[str, int]) -> str:
    arms = " ".join(f"WHEN event_id % {k} THEN {v}" for k, v in special.items())
    return f"CAST(CASE {arms} ELSE {feature(multiplier)} END AS DECIMAL(10,6))"


#: fixed values: FIXTURES.md, sections 3 to 5
MULTIPLIERS = (7919, 104729, 1299709, 15485863, 32452843, 7, 11, 13, 17, 19, 23, 29, 31, 37,
               41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101)
SPECIAL = (
    {"499 = 0": -15, "499 = 250": 25},
    {"499 = 0": 8},
    {"1497 = 0": -75, "499 = 0": -52, "499 = 125": -45, "97 = 31": -18},
    {"499 = 0": 9},
    {"499 = 0": -20, "499 = 100": 50},
)
SECOND = "CAST(CAST(floor(epoch(ts)) AS BIGINT) % 172800 AS INTEGER)"
AMOUNT = ("CAST(CASE WHEN event_id % 499 = 0 THEN [99.99, 1.00, 0.01, 5.00][event_id % 4 + 1] "
          "WHEN event_id % 50 = 7 THEN CAST(value AS DECIMAL(10,2)) * 20 ELSE CAST(value AS DECIMAL(10,2)) END AS DECIMAL(10,2))")
GUILTY = "coalesce((event_id % 499 = 0 AND event_id % 7 <> 3) OR (event_type = 'error' AND event_id % 20 = 7), false)"
FIVE = range(1, 6)

PAYMENT = ("payment AS (SELECT event_id AS transaction_id, user_id AS customer_id, ts, " + f"{SECOND} AS transaction_time, {AMOUNT} AS amount, "
           + ", ".join(f"{feature_with(MULTIPLIERS[i - 1], SPECIAL[i - 1])} AS v{i}" for i in FIVE) + " FROM events)")
VERDICT = (f"verdict AS (SELECT event_id AS transaction_id, unnest(CASE WHEN event_id % 1000 = 3 THEN [] WHEN event_id % 500 = 2 "
           f"THEN [{GUILTY}, NOT {GUILTY}] ELSE [{GUILTY}] END) AS is_fraud FROM events)")

SEGMENTS = table("segment", "seg, above, upto, seg_long, seg_short", [
    (i + 1, ([-1e12, *C.SEGMENT_LIMITS])[i], ([*C.SEGMENT_LIMITS, 1e12])[i], C.SEGMENT_LABELS[i], C.SEGMENT_SHORT_LABELS[i])
    for i in range(len(C.SEGMENT_LABELS))])
PERIODS = table("period", "per, per_label", [(i + 1, x) for i, x in enumerate(C.PERIOD_LABELS)])
VALUE_BAND = f"1 + (amount > {C.VALUE_BAND_LIMITS[0]})::INT + (amount > {C.VALUE_BAND_LIMITS[1]})::INT"
PERIOD_OF = (f"CASE WHEN transaction_time BETWEEN 0 AND {C.PERIOD_FOLDED_DAYS * C.SECONDS_PER_DAY - 1} "
             f"THEN transaction_time % {C.SECONDS_PER_DAY} // {C.PERIOD_SECONDS} + 1 ELSE {len(C.PERIOD_LABELS)} END")

CENTRE = ("centre AS (SELECT avg(amount::DOUBLE) AS amount_mean, stddev_samp(amount::DOUBLE) AS amount_sd, "
          + ", ".join(f"avg(v{i}::DOUBLE) AS m{i}, stddev_samp(v{i}::DOUBLE) AS s{i}" for i in FIVE)
          + ", count(*) AS n, sum(amount) AS volume FROM payment JOIN verdict USING (transaction_id))")
GAUGED = ("gauged AS (SELECT payment.*, is_fraud, amount_mean, amount_sd, n AS n_all, volume AS volume_all, "
          + ", ".join(f"abs(v{i}::DOUBLE - m{i}) / nullif(s{i}, 0) AS z{i}" for i in FIVE)
          + f", {' + '.join(f'z{i}' for i in FIVE)} AS z_total, z_total / 5 AS z_mean, greatest({', '.join(f'z{i}' for i in FIVE)}) AS z_top"
          + f", (transaction_time - CASE WHEN transaction_time >= {C.SECONDS_PER_DAY} THEN {C.SECONDS_PER_DAY} ELSE 0 END)"
          + f" // {C.SECONDS_PER_HOUR} AS hour_of_day, {PERIOD_OF} AS per, {VALUE_BAND} AS band"
          + " FROM payment JOIN verdict USING (transaction_id) CROSS JOIN centre)")
TOTALS = ("totals AS (SELECT (SELECT count(*) FROM payment) AS n_tx, (SELECT sum(amount) FROM payment) AS vol_tx, "
          "(SELECT count(*) FROM verdict) AS n_cases, (SELECT count(*) FILTER (is_fraud) FROM verdict) AS n_guilty, "
          "(SELECT count(*) FILTER (NOT is_fraud) FROM verdict) AS n_innocent, "
          "count(*) FILTER (is_fraud) AS n_loss, sum(amount) FILTER (is_fraud) AS loss FROM gauged)")


def query(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([PAYMENT, VERDICT, CENTRE, GAUGED, SEGMENTS, PERIODS, TOTALS, *more]) + "\n" + body


PATTERN = f"amount IN ({', '.join(map(str, C.PATTERN_AMOUNTS))})"
#: fixed values: rules of the V3 pattern, first match wins
RULES = [(f"z3 > {C.PATTERN_V3_Z} AND {PATTERN}", C.ACTION_BLOCK), (f"z3 > {C.REVIEW_V3_Z} AND amount < {C.REVIEW_MAX_AMOUNT}", C.ACTION_REVIEW),
         (f"z3 > {C.MONITOR_V3_Z}", C.ACTION_MONITOR)]
ACTION = "coalesce(" + ", ".join(f"CASE WHEN {rule} THEN '{label}' END" for rule, label in RULES) + f", '{C.ACTION_NORMAL}')"

# --- detectors --------------------------------------------------------------------
FIRES = ("CASE measure WHEN 'amount' THEN amount::DOUBLE > amount_mean + (cutoff * amount_sd) WHEN 'mean' THEN z_mean > cutoff "
         f"WHEN 'v3' THEN z3 > cutoff ELSE z3 > cutoff AND {PATTERN} END")
HITS = ("hits AS (SELECT ord, label, note, count(*) FILTER (fires) AS flagged, count(*) FILTER (fires AND is_fraud) AS caught, "
        f"count(*) FILTER (fires AND NOT is_fraud) AS wrong FROM (SELECT d.*, is_fraud, {FIRES} AS fires FROM gauged CROSS JOIN detector AS d) "
        "GROUP BY ord, label, note)")


def detectors(rows) -> tuple[str, str]:
    body = ", ".join(f"({i}, '{label}', '{measure}', {cutoff}::DOUBLE, {lit(note)})" for i, (label, measure, cutoff, note) in enumerate(rows, 1))
    return f"detector(ord, label, measure, cutoff, note) AS (VALUES {body})", HITS


def three_methods(labels, notes=(None, None, None)):
    kinds = (("amount", C.OPTIMAL_AMOUNT_MULTIPLIER), ("v3", C.STATISTICAL_V3_Z), ("pattern", C.PATTERN_V3_Z))
    return detectors([(label, *kind, note) for label, kind, note in zip(labels, kinds, notes)])


def sweep(rows) -> str:
    return query(f"SELECT label AS threshold_type, flagged AS flagged_transactions, caught AS fraud_caught, "
                 f"{percent('caught', 'flagged', 2)} AS precision_percentage FROM hits", *detectors(rows))


COMPARED = (f"SELECT label AS detection_method, flagged AS total_flagged, caught AS fraud_caught, wrong AS false_positives, "
            f"{percent('caught', 'flagged', 2)} AS precision_percentage, "
            f"{percent('caught', '(SELECT n_guilty FROM totals)', 2)} AS recall_percentage")
DOMINANT = "'V' || list_position([" + ", ".join(f"z{i}" for i in FIVE) + "], z_top) || '_dominant'"
FLAGGED = f"flagged AS (SELECT * FROM gauged WHERE amount::DOUBLE > amount_mean + ({C.OPTIMAL_AMOUNT_MULTIPLIER} * amount_sd))"


def by_hour(columns: str, where: str = "true") -> str:
    return query(f"SELECT hour_of_day, count(*) AS total_transactions, {columns} FROM gauged WHERE {where} GROUP BY hour_of_day")


GUILTY_N = "count(*) FILTER (is_fraud)"
HOURLY_SHARES = (f"{percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate_percentage, "
                 f"{percent(GUILTY_N, '(SELECT n_guilty FROM totals)', 1)} AS fraud_distribution_percentage")
LOSS = "sum(amount) FILTER (is_fraud)"
TOTAL = "totals"

ORACLE_SQL: dict[str, str] = {
    "fraud_overview": query(
        "SELECT unnest([" + ", ".join(
            "{'metric': '%s', 'count': %s, 'percentage': %s}" % (m, n, p) for m, n, p in zip(
                C.OVERVIEW_METRICS, ("n_cases", "n_guilty", "n_innocent"),
                (f"'{C.OVERVIEW_TOTAL_PERCENT}'", text(percent("n_guilty", "n_cases", 3)), text(percent("n_innocent", "n_cases", 3)))))
        + "], recursive := true) FROM totals"),
    "amount_threshold_sweep": sweep([(label, "amount", k, None) for label, k in zip(C.AMOUNT_SWEEP_LABELS, C.AMOUNT_SD_MULTIPLIERS)]),
    "zscore_threshold_sweep": sweep([(label, "mean", k, None) for label, k in zip(C.ZSCORE_SWEEP_LABELS, C.ZSCORE_THRESHOLDS)]),
    "method_comparison": query(COMPARED + " FROM hits", *three_methods(C.METHOD_LABELS_LONG)),
    "detector_extras": query(
        COMPARED + f", {percent('wrong', 'flagged', 2)} AS false_discovery_percentage, "
        f"{percent('max(flagged) OVER () - flagged', 'max(flagged) OVER ()', 2)} AS workload_reduction_percentage FROM hits",
        *three_methods(C.METHOD_LABELS_LONG)),
    "view_detection_performance": query(
        f"SELECT label AS detection_method, flagged AS total_flagged, caught AS fraud_caught, "
        f"{percent('caught', 'flagged', 2)} AS precision_percentage, note AS performance_note FROM hits",
        *three_methods(C.METHOD_LABELS_SHORT, C.METHOD_NOTES)),
    "amount_flagged_top50": query(
        f"SELECT transaction_id, amount, is_fraud, {mean_money('volume_all', 'n_all')} AS avg_amount, "
        f"{rounded(f'amount_mean + ({C.OPTIMAL_AMOUNT_MULTIPLIER} * amount_sd)')} AS optimal_threshold, '{C.REVIEW_PRIORITY_HIGH}' AS review_priority, "
        f"coalesce({percent('(SELECT count(*) FROM flagged AS f WHERE f.amount < t.amount)', '(SELECT count(*) - 1 FROM flagged)', 2)}, 0) AS amount_percentile "
        "FROM (SELECT * FROM flagged ORDER BY amount DESC, transaction_id, is_fraud LIMIT 50) AS t", FLAGGED),
    "amount_flagged_ranked": query(
        f"SELECT transaction_id, amount, is_fraud, {mean_money('volume_all', 'n_all')} AS avg_amount, "
        f"{rounded(f'amount_mean + ({C.OPTIMAL_AMOUNT_MULTIPLIER} * amount_sd)')} AS optimal_threshold, '{C.REVIEW_PRIORITY_HIGH}' AS review_priority, "
        f"coalesce({percent('below', 'others', 2)}, 0) AS amount_percentile "
        "FROM (SELECT *, rank() OVER (ORDER BY amount) - 1 AS below, count(*) OVER () - 1 AS others FROM flagged)", FLAGGED),
    "zscore_outliers_top50": query(
        "SELECT transaction_id, amount, is_fraud, " + ", ".join(f"{rounded(f'z{i}')} AS v{i}_zscore" for i in FIVE)
        + f", {rounded('z_mean')} AS avg_zscore, '{C.OUTLIER_LABEL}' AS outlier_classification, {DOMINANT} AS dominant_outlier_feature "
        f"FROM gauged WHERE z_mean > {C.OUTLIER_AVG_Z} ORDER BY is_fraud DESC NULLS FIRST, avg_zscore DESC NULLS FIRST, transaction_id LIMIT 50"),
    "v3_pattern_top100": query(
        f"SELECT transaction_id, amount, is_fraud, {rounded('z3')} AS v3_zscore, {ACTION} AS fraud_action, '{C.PATTERN_METHOD_TAG}' AS detection_method "
        f"FROM gauged WHERE z3 > {C.MONITOR_V3_Z} ORDER BY v3_zscore DESC, transaction_id, is_fraud LIMIT 100"),
    "view_high_risk_transactions": query(
        f"SELECT transaction_id, amount, is_fraud, {rounded('z3')} AS v3_risk_score, {ACTION} AS recommended_action, "
        f"'{C.TEST_LOAD_TIME}' AS analysis_timestamp FROM gauged WHERE z3 > {C.MONITOR_V3_Z}"),
    "outlier_dominance": query(
        f"SELECT is_fraud, {DOMINANT} AS dominant_outlier_feature, count(*) AS transactions FROM gauged WHERE z_mean > {C.OUTLIER_AVG_Z} GROUP BY ALL"),
    "v3_profile": query(
        f"SELECT is_fraud, count(*) AS transactions, {ratio('CAST(sum(v3) * 1000000 AS HUGEINT)', 'count(v3) * 1000000', 4)} AS v3_mean, "
        f"{rounded('stddev_samp(v3::DOUBLE)', 4)} AS v3_stddev, min(v3) AS v3_min, max(v3) AS v3_max, "
        f"count(*) FILTER (z3 > {C.STATISTICAL_V3_Z}) AS beyond_statistical_line FROM gauged GROUP BY is_fraud"),
    "amount_percentiles": query(
        "SELECT " + ", ".join(
            f"(SELECT min(amount) + (max(amount) - min(amount)) * any_value(frac) FROM (SELECT amount, place, (n_all - 1) * {p}::DECIMAL(3,2) AS x, "
            f"x - floor(x) AS frac FROM ranked) WHERE place IN (floor(x), ceil(x))) AS {name}" for name, p in (("p95_amount", "0.95"), ("p99_amount", "0.99"))),
        "ranked AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS place, count(*) OVER () AS n_all FROM gauged WHERE amount IS NOT NULL)"),
    "hourly_amount_percentiles": query(
        "SELECT hour_of_day, " + ", ".join(
            f"max(amount) FILTER (place = floor(({p}) * (n_hour - 1))) + (max(amount) FILTER (place = ceil(({p}) * (n_hour - 1))) "
            f"- max(amount) FILTER (place = floor(({p}) * (n_hour - 1)))) * (({p}) * (any_value(n_hour) - 1) - floor(({p}) * (any_value(n_hour) - 1))) AS {name}"
            for name, p in (("p50_amount", "0.5::DECIMAL(3,2)"), ("p95_amount", "0.95::DECIMAL(3,2)"), ("p99_amount", "0.99::DECIMAL(3,2)")))
        + " FROM placed GROUP BY hour_of_day",
        "placed AS (SELECT hour_of_day, amount, row_number() OVER (PARTITION BY hour_of_day ORDER BY amount) - 1 AS place, "
        "count(*) OVER (PARTITION BY hour_of_day) AS n_hour FROM gauged WHERE amount IS NOT NULL)"),
    "hourly_fraud": by_hour(f"{GUILTY_N} AS fraud_count, {HOURLY_SHARES}"),
    "view_fraud_hourly_stats": by_hour(f"{GUILTY_N} AS fraud_count, count(*) FILTER (NOT is_fraud) AS normal_count, {HOURLY_SHARES}"),
    "hourly_financials": by_hour(
        f"{GUILTY_N} AS fraud_count, {percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate_percentage, {euro('round(sum(amount), 0)')} AS hourly_volume, "
        f"{euro(f'round({LOSS}, 2)')} AS fraud_loss, {percent(cent(LOSS), cent('sum(amount)'), 4)} AS fraud_loss_ratio_percentage"),
    "executive_summary": query(lines(
        ("kpi_category", "metric", "value", "benchmark"),
        [(f"'{a}'", f"'{b}'", v, w) for (a, b), v, w in zip(
            C.SUMMARY_ROWS,
            ("n_tx", "n_guilty", euro_grouped("vol_tx"), euro_grouped("loss"), euro_grouped(mean_money("vol_tx", "n_tx"))),
            (f"'{C.SUMMARY_FULL_BENCHMARK}'", text(percent("n_guilty", "n_tx", 3)), f"'{C.SUMMARY_FULL_BENCHMARK}'",
             text(percent(cent("loss"), cent("vol_tx"), 3)), f"'{C.SUMMARY_AVERAGE_BENCHMARK}'"))], TOTAL)),
    "financial_impact": query(lines(
        ("analysis_category", "metric", "value", "percentage_of_volume"),
        [(f"'{a}'", f"'{b}'", v, w) for (a, b), v, w in zip(
            C.IMPACT_ROWS,
            (euro("round(loss, 2)"), euro(mean_money("loss", "n_loss")), euro(ratio(cent("loss"), str(C.OBSERVED_HOURS * 100), 2)),
             text(percent("n_loss", "n_tx", 3)), text(percent("caught", "flagged", 2))),
            (text(percent(cent("loss"), cent("vol_tx"), 4)),
             text(percent(f"{cent('loss')} * n_tx", f"n_loss * {cent('vol_tx')}", 1), C.IMPACT_VS_AVG_SUFFIX),
             f"'{C.IMPACT_PER_HOUR_NOTE}'", f"'{C.IMPACT_RATE_NOTE.format(C.INDUSTRY_BENCHMARK_PCT)}'", f"'{C.IMPACT_PRECISION_NOTE}'"))],
        "totals, (SELECT * FROM hits WHERE ord = 3)"), *three_methods(C.METHOD_LABELS_SHORT)),
    "segment_analysis": query(
        f"SELECT seg_long AS amount_segment, count(*) AS total_transactions, {GUILTY_N} AS fraud_transactions, "
        f"{percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate_percentage, {euro('round(sum(amount), 0)')} AS segment_volume, "
        f"{euro(f'round({LOSS}, 2)')} AS fraud_loss, {percent(cent(LOSS), cent('sum(amount)'), 3)} AS volume_loss_percentage, "
        f"{euro(mean_money('sum(amount)', 'count(*)'))} AS avg_transaction, {euro(mean_money(LOSS, GUILTY_N))} AS avg_fraud_amount, "
        f"{percent('count(*)', 'any_value(n_all)', 1)} AS transaction_share_percentage, "
        f"{percent(cent('sum(amount)'), cent('(SELECT vol_tx FROM totals)'), 1)} AS volume_share_percentage "
        "FROM gauged JOIN segment ON amount > above AND amount <= upto GROUP BY seg, seg_long"),
    "view_segment_performance": query(
        f"SELECT seg_short AS segment, count(*) AS transactions, {GUILTY_N} AS fraud_count, {percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate, "
        f"CAST(sum(amount) AS DECIMAL(20,2)) AS volume, CAST({LOSS} AS DECIMAL(20,2)) AS fraud_volume, "
        f"{percent(cent(LOSS), cent('sum(amount)'), 4)} AS loss_rate, '{C.TEST_LOAD_TIME}' AS report_timestamp FROM gauged JOIN segment ON amount > above AND amount <= upto GROUP BY seg, seg_short"),
    "view_executive_dashboard": query(
        f"SELECT count(*) AS total_transactions, {GUILTY_N} AS fraud_cases, {percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate, "
        f"CAST(sum(amount) AS DECIMAL(20,2)) AS total_volume, CAST({LOSS} AS DECIMAL(20,2)) AS fraud_loss, "
        f"{percent(cent(LOSS), cent('sum(amount)'), 4)} AS loss_percentage, "
        f"{mean_money('sum(amount)', 'count(*)', 6)} AS avg_transaction, '{C.TEST_LOAD_TIME}' AS report_timestamp FROM gauged"),
    "period_trends": query(
        f"SELECT per_label AS time_period, count(*) AS total_transactions, {GUILTY_N} AS fraud_count, {percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate_percentage, "
        f"{euro('round(sum(amount), 0)')} AS period_volume, {euro(f'round({LOSS}, 2)')} AS fraud_loss, {euro(mean_money('sum(amount)', 'count(*)'))} AS avg_transaction, "
        + ", ".join(f"{percent(f'count(*) FILTER (band = {i})', 'count(*)', 1)} AS {name}_value_percentage" for i, name in ((1, "low"), (2, "medium"), (3, "high")))
        + f", count(*) FILTER (band = 3 AND is_fraud) AS high_value_fraud, "
        f"coalesce({percent('count(*) FILTER (band = 3 AND is_fraud)', 'count(*) FILTER (band = 3)', 2)}, 0) AS high_value_fraud_rate "
        "FROM gauged JOIN period USING (per) GROUP BY per, per_label"),
    "customer_rollup": query(
        f"SELECT customer_id, count(*) AS total_transactions, CAST(sum(amount) AS DECIMAL(20,2)) AS total_amount, "
        f"{mean_money('sum(amount)', 'count(*)')} AS avg_transaction_amount, max(transaction_time) AS last_transaction_time, "
        f"'{C.TEST_LOAD_TIME[:10]} 00:00:00' AS created_date, "
        f"strftime(TIMESTAMP '{C.TEST_LOAD_TIME}' + to_seconds(max(transaction_time)), '%Y-%m-%d %H:%M:%S') AS last_transaction_date, "
        f"{C.DEFAULT_RISK_SCORE} AS risk_score, true AS is_active FROM payment GROUP BY customer_id"),
}


def parameters(first: int, last: int, z: float) -> str:
    return by_hour(f"{GUILTY_N} AS fraud_count, {percent(GUILTY_N, 'count(*)', 3)} AS fraud_rate, count(*) FILTER (z3 > {z}) AS high_risk_transactions",
                   f"hour_of_day BETWEEN {first} AND {last}")


ORACLE_SQL["analyze_fraud_by_parameters"] = parameters(0, 23, 10.0)
ORACLE_SQL["analyze_fraud_by_parameters_2_6_12"] = parameters(2, 6, 12.0)
ORACLE_SQL["sql_table_function"] = parameters(2, 6, 10.0)
SNAPSHOT = {"detection_performance_summary": "3", "executive_dashboard": "1", "fraud_hourly_stats": "count(DISTINCT hour_of_day)",
            "high_risk_transactions": f"count(*) FILTER (z3 > {C.MONITOR_V3_Z})",
            "segment_performance": "count(DISTINCT 0 + " + " + ".join(f"(amount > {x})::INT" for x in C.SEGMENT_LIMITS) + ")"}
ORACLE_SQL["view_snapshots"] = query(
    "SELECT unnest([" + ", ".join(f"{{'view_name': '{v}', 'snapshot_date': '{C.TEST_LOAD_TIME[:10]}', 'row_count': CAST(n_{v} AS BIGINT)}}" for v in SNAPSHOT)
    + "], recursive := true) FROM (SELECT " + ", ".join(f"{n} AS n_{v}" for v, n in SNAPSHOT.items()) + " FROM gauged)")

# --- recommendations: each line from its own best row, or n/a ------------------------
BENCH = C.INDUSTRY_BENCHMARK_PCT
HH = "lpad(CAST({0} AS VARCHAR), greatest(2, length(CAST({0} AS VARCHAR)))::INTEGER, '0') || ':00'"
BEST = (
    # two consecutive hours: pairs of hours as a range frame over the hour itself
    f"peak AS (SELECT arg_min(h, (-rate, h)) AS peak_hour, arg_min(rate, (-rate, h)) AS peak_rate FROM ("
    f"SELECT h, {percent('sum(f) OVER w', 'sum(n) OVER w', 2)} AS rate, count(*) OVER w AS width FROM "
    f"(SELECT hour_of_day AS h, count(*) AS n, {GUILTY_N} AS f FROM gauged GROUP BY 1) "
    f"WINDOW w AS (ORDER BY h RANGE BETWEEN CURRENT ROW AND {C.PEAK_WINDOW_HOURS - 1} FOLLOWING)) WHERE width = {C.PEAK_WINDOW_HOURS})",
    f"worst AS (SELECT arg_min(seg_long, (-rate, seg)) AS seg_name, arg_min(rate, (-rate, seg)) AS seg_rate FROM ("
    f"SELECT seg, seg_long, {percent(GUILTY_N, 'count(*)', 2)} AS rate FROM gauged JOIN segment ON amount > above AND amount <= upto GROUP BY ALL))",
    f"sharpest AS (SELECT arg_min(label, (-p, ord)) AS method, arg_min(p, (-p, ord)) AS method_precision FROM "
    f"(SELECT *, {percent('caught', 'flagged', 2)} AS p FROM hits) WHERE p IS NOT NULL)",
    f"compared AS (SELECT {percent('n_loss', 'n_tx', 3)} AS rate, {percent(cent('loss'), cent('vol_tx'), 3)} AS share, "
    f"{percent('5 * n_tx - 1000 * n_loss', '5 * n_tx', 0)} AS better FROM totals)",
)


def or_none(x: str) -> str:
    return f"coalesce({x}, '{C.INSIGHT_NO_DATA}')"


_OPS, _BENCH, _T, _A = f"'{C.INSIGHT_CATEGORY_OPS}'", f"'{C.INSIGHT_CATEGORY_BENCH}'", [f"'{t}'" for t in C.INSIGHT_TYPES], C.INSIGHT_ACTIONS
ORACLE_SQL["operational_insights"] = query(lines(
    ("category", "recommendation_type", "timeframe", "action_required"),
    [(_OPS, _T[0], or_none(f"{HH.format('peak_hour')} || '-' || {HH.format(f'(peak_hour + {C.PEAK_WINDOW_HOURS})')}"), or_none(text("peak_rate", "%" + _A[0]))),
     (_OPS, _T[1], or_none("seg_name"), or_none(text("seg_rate", "%" + _A[1]))),
     (_OPS, _T[2], or_none("method"), or_none(text("method_precision", "%" + _A[2]))),
     (_OPS, _T[3], f"'{C.INSIGHT_ALERT_TIMEFRAME}'", f"'{C.INSIGHT_ALERT_ACTION}'"),
     (_BENCH, _T[4], text("rate", f"% vs {BENCH}%"),
      f"CAST(abs(better) AS VARCHAR) || '% ' || CASE WHEN better >= 0 THEN 'better' ELSE 'worse' END || ' than industry benchmark'"),
     (_BENCH, _T[5], text("share", "% of volume"),
      f"CASE WHEN share < {BENCH} THEN 'Well below' ELSE 'Above' END || ' industry average of {BENCH}%+'")],
    "peak, worst, sharpest, compared"), *three_methods(C.METHOD_LABELS_SHORT), *BEST)

# --- ingest ---------------------------------------------------------------------
_V = [f"v{i}" for i in range(1, C.N_FEATURES + 1)]
RAW = ("raw AS (SELECT time_seconds, " + ", ".join(_V) + ", amount, unnest(CASE event_id % 1000 WHEN 1 THEN [code, code] WHEN 2 THEN [code, 1 - code] "
       "WHEN 4 THEN [NULL] WHEN 5 THEN [code, 2] ELSE [code] END) AS class FROM (SELECT event_id, "
       f"{SECOND} AS time_seconds, {AMOUNT} AS amount, {GUILTY}::INT AS code, "
       + ", ".join(f"CAST({feature(m)} + CAST(event_id % 10 AS DECIMAL(2,0)) * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(15,10))"
                   f"{' * CASE WHEN event_id % 1000 <> 3 THEN 1 END' if i == C.N_FEATURES else ''} AS v{i}" for i, m in enumerate(MULTIPLIERS, 1))
       + " FROM events))")
STAGED = ("staged AS (SELECT time_seconds AS transaction_time, amount, class, "
          + ", ".join(f"CAST(round({v}, 6) AS DECIMAL(10,6)) AS {v}" for v in _V) + " FROM raw)")
KEYS = ["amount", "transaction_time", *_V]
NUMBERED = ("numbered AS (SELECT row_number() OVER (ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in ["transaction_time", "amount", *_V, "class"])
            + ") AS transaction_id, * EXCLUDE (class) FROM staged)")
CASES = (f"labels AS (SELECT DISTINCT {', '.join(KEYS)}, class IS NOT DISTINCT FROM 1 AS is_fraud FROM staged)",
         "filed AS (SELECT row_number() OVER (ORDER BY transaction_id, is_fraud) AS case_id, transaction_id, is_fraud "
         f"FROM numbered JOIN labels USING ({', '.join(KEYS)}))")


def loaded(body: str) -> str:
    return "WITH " + ",\n".join([RAW, STAGED, NUMBERED, *CASES]) + "\n" + body


def stacked(columns: tuple[str, ...], rows, source: str) -> str:
    records = ", ".join("{" + ", ".join(f"'{c}': {e}" for c, e in zip(columns, r)) + "}" for r in rows)
    return f"SELECT unnest([{records}], recursive := true) FROM {source}"


_TABLES = [t for t, _ in C.VALIDATION_ROWS]
ORACLE_SQL |= {
    "ingest_staging": loaded("FROM raw"),
    "load_transactions": loaded(f"SELECT transaction_id, CAST(NULL AS BIGINT) AS customer_id, CAST(NULL AS TIMESTAMP) AS transaction_timestamp, "
                                f"{', '.join(KEYS)}, '{C.TEST_LOAD_TIME}' AS created_at FROM numbered"),
    "load_fraud_cases": loaded(
        f"SELECT case_id, transaction_id, CAST(NULL AS BIGINT) AS customer_id, is_fraud, '{C.LABEL_METHOD}' AS detection_method, "
        f"CAST(CASE WHEN is_fraud THEN {C.FRAUD_PROBABILITY} ELSE {C.NORMAL_PROBABILITY} END AS DECIMAL(5,4)) AS fraud_probability, "
        f"'pending' AS investigation_status, '{C.TEST_LOAD_TIME}' AS reported_date, CAST(NULL AS TIMESTAMP) AS resolved_date, "
        "CAST(0 AS DECIMAL(10,2)) AS financial_loss FROM filed"),
    "validate_counts": loaded(stacked(
        ("table_name", "row_count", "description"),
        [(f"'{t}'", f"(SELECT count(*) FROM {rel})", f"'{d}'") for (t, d), rel in zip(C.VALIDATION_ROWS, ("raw", "numbered", "filed"))], "(SELECT 1)")),
    "fraud_distribution": loaded(f"SELECT is_fraud, count(*) AS case_count, {percent('count(*)', '(SELECT count(*) FROM filed)', 2)} AS percentage "
                                 "FROM filed GROUP BY is_fraud"),
    "dq_not_null": loaded(stacked(
        ("table_name", "column_name", "null_count"),
        [(f"'{t}'", f"'{c}'", f"(SELECT count(*) - count({c}) FROM {rel})") for t, c, rel in (
            (_TABLES[1], "amount", "numbered"), (_TABLES[1], "transaction_time", "numbered"), (_TABLES[2], "is_fraud", "filed"))], "(SELECT 1)")),
    "dq_unique_key": loaded(stacked(
        ("table_name", "key_column", "duplicate_keys", "rows_with_duplicate_key"),
        [(f"'{t}'", f"'{k}'", f"(SELECT count(*) FROM (SELECT 1 FROM {rel} GROUP BY {k} HAVING count(*) > 1))",
          f"(SELECT count(*) FROM {rel} AS a WHERE (SELECT count(*) FROM {rel} AS b WHERE b.{k} = a.{k}) > 1)")
         for t, k, rel in ((_TABLES[1], "transaction_id", "numbered"), (_TABLES[2], "case_id", "filed"))], "(SELECT 1)")),
    "dq_orphans": loaded(stacked(
        ("check_name", "row_count"),
        [("'fraud case without transaction'", "(SELECT count(*) FROM filed ANTI JOIN numbered USING (transaction_id))"),
         ("'transaction without fraud case'", "(SELECT count(*) FROM numbered ANTI JOIN filed USING (transaction_id))")], "(SELECT 1)")),
}

ORACLE_SQL["csv_ingest_round_trip"] = ORACLE_SQL["ingest_staging"]
ORACLE_SQL["catalog_scan"] = ORACLE_SQL["validate_counts"]
ORACLE_SQL["catalog_lifecycle"] = loaded(stacked(
    ("step", "object_name", "row_count"),
    [*[("'schema'", f"'{s}'", "-1") for s in ("analytics", "fraud_detection", "staging")], ("'published'", f"'{_TABLES[0]}'", "(SELECT count(*) FROM raw)"),
     ("'truncated'", f"'{_TABLES[0]}'", "0"), ("'dropped'", f"'{_TABLES[0]}'", "-1")], "(SELECT 1)"))
ORACLE_SQL |= {f"stored_view_{stored}": ORACLE_SQL[own] for stored, own in {
    "fraud_hourly_stats": "view_fraud_hourly_stats", "high_risk_transactions": "view_high_risk_transactions",
    "detection_performance_summary": "view_detection_performance", "executive_dashboard": "view_executive_dashboard",
    "segment_performance": "view_segment_performance"}.items()}

# two files, each numbered on its own after the ids of the one before
SECOND_FILE = "TIMESTAMP '2024-01-16 00:00:00'"


def one_file(tag: str, condition: str) -> list[str]:
    return [re.sub(r"\b(raw|staged|numbered|labels|filed)\b", rf"\1_{tag}", cte).replace("FROM events", f"FROM events WHERE {condition}")
            for cte in (RAW, STAGED, NUMBERED, *CASES)]


def file_rows(tag: str, after: str, cases_after: str) -> str:
    return (f"SELECT transaction_id + {after} AS transaction_id, '{tag}' AS batch_id, transaction_time, amount, v1, v27, "
            f"coalesce(c.n, 0) AS case_count, coalesce(c.f, 0) AS fraud_count, coalesce(c.first + {cases_after}, 0) AS first_case_id "
            f"FROM numbered_{tag} LEFT JOIN (SELECT transaction_id, count(*) AS n, count(*) FILTER (is_fraud) AS f, min(case_id) AS first "
            f"FROM filed_{tag} GROUP BY 1) AS c USING (transaction_id)")


ORACLE_SQL["append_load"] = ("WITH " + ",\n".join([*one_file("file1", f"ts < {SECOND_FILE}"), *one_file("file2", f"ts >= {SECOND_FILE}")]) + "\n"
                             + file_rows("file1", "0", "0") + "\nUNION ALL\n"
                             + file_rows("file2", "(SELECT count(*) FROM numbered_file1)", "(SELECT count(*) FROM filed_file1)"))

# the views over both files: every numbered row with each of its cases
BOTH_FILES = [*one_file("file1", f"ts < {SECOND_FILE}"), *one_file("file2", f"ts >= {SECOND_FILE}"),
              "filed_rows AS (SELECT is_fraud FROM filed_file1 UNION ALL SELECT is_fraud FROM filed_file2)",
              "appended AS (" + " UNION ALL ".join(f"SELECT transaction_time, amount, is_fraud FROM numbered_{f} JOIN (SELECT transaction_id, is_fraud "
                                                   f"FROM filed_{f}) USING (transaction_id)" for f in ("file1", "file2")) + ")"]


def appended_view(name: str, item: str, share: str, source: str = "appended") -> str:
    return (f"SELECT '{name}' AS view_name, CAST({item} AS VARCHAR) AS item, count(*) AS transactions, {GUILTY_N} AS fraud_count, "
            f"CAST({percent(GUILTY_N, 'count(*)', 3)} AS DOUBLE) AS fraud_rate, CAST({share} AS DOUBLE) AS share FROM {source} GROUP BY ALL")


ORACLE_SQL["incremental_views"] = "WITH " + ",\n".join([*BOTH_FILES, SEGMENTS]) + "\n" + "\nUNION ALL\n".join([
    appended_view("fraud_hourly_stats", "(transaction_time - CASE WHEN transaction_time >= 86400 THEN 86400 ELSE 0 END) // 3600",
                  percent(GUILTY_N, "(SELECT count(*) FILTER (is_fraud) FROM filed_rows)", 1)),
    appended_view("segment_performance", "seg_short", percent(cent(LOSS), cent("sum(amount)"), 4),
                  "appended JOIN segment ON amount > above AND amount <= upto"),
    appended_view("executive_dashboard", "'all'", percent(cent(LOSS), cent("sum(amount)"), 4))])

# --- streaming: every payment, labelled or not, against the labelled centre ------------
ARRIVING = "arriving AS (SELECT transaction_id, ts, amount, abs(v3::DOUBLE - m3) / nullif(s3, 0) AS z3 FROM payment CROSS JOIN centre)"
STAMP = "'%Y-%m-%d %H:%M:%S'"
ORACLE_SQL |= {
    "stream_score": query(
        f"SELECT transaction_id, strftime(ts, {STAMP}) AS event_time, amount, {rounded('z3')} AS v3_risk_score, {ACTION} AS recommended_action "
        f"FROM arriving WHERE z3 > {C.MONITOR_V3_Z}", ARRIVING),
    "stream_hourly_alerts": query(
        f"SELECT strftime(opened, {STAMP}) AS window_start, strftime(opened + INTERVAL 1 HOUR, {STAMP}) AS window_end, count(*) AS transactions, "
        f"count(*) FILTER (z3 > {C.MONITOR_V3_Z}) AS high_risk, count(*) FILTER (z3 > {C.PATTERN_V3_Z} AND {PATTERN}) AS immediate_block, "
        "CAST(sum(amount) AS DECIMAL(20,2)) AS volume FROM (SELECT *, date_trunc('hour', ts) AS opened FROM arriving) GROUP BY opened", ARRIVING),
    # an episode starts where the hit before lies more than the cooldown back
    "stream_rule_episodes": query(
        f"SELECT rule, strftime(min(ts), {STAMP}) AS first_hit, strftime(max(ts), {STAMP}) AS last_hit, count(*) AS hits, "
        f"CAST(sum(amount) AS DECIMAL(20,2)) AS volume, {rounded('max(z3)')} AS max_risk_score FROM ("
        "SELECT *, sum(starts) OVER (PARTITION BY rule ORDER BY ts RANGE UNBOUNDED PRECEDING) AS episode FROM ("
        "SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY rule ORDER BY ts) > INTERVAL 12 HOUR, true)::INT AS starts FROM ("
        f"SELECT ts, amount, z3, {ACTION} AS rule FROM arriving WHERE z3 > {C.MONITOR_V3_Z}))) GROUP BY rule, episode", ARRIVING),
}


# --- driver-facing output types -----------------------------------------------------
def _engine_neutral(name: str, sql: str) -> str:
    from .output_types import DOUBLE_COLUMNS, DROPPED_COLUMNS

    doubles, dropped = DOUBLE_COLUMNS.get(name, ()), DROPPED_COLUMNS.get(name, ())
    columns = "*" + (f" EXCLUDE ({', '.join(dropped)})" if dropped else "")
    if doubles:
        columns += " REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles) + ")"
    return sql if columns == "*" else f"SELECT {columns} FROM (\n{sql}\n) AS q"


ORACLE_SQL = {name: _engine_neutral(name, sql) for name, sql in ORACLE_SQL.items()}
