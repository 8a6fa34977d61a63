"""Named queries over a test-data folder: ``name -> fn(spark, sf_dir)``.

Every entry reads the folder's tables (through the fixture mapping) and runs
over all rows. Views and loads are registered at a fixed time, as text, so that
results are reproducible.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import append, catalog, detect, extras, ingest, params, report, view_sql, view_state, views
from ..constants import TEST_LOAD_TIME
from ..session import checkpoint_path
from ..sources import fixtures
from ..sources.card_csv import read_card_csv, write_card_csv
from ..sources.testdata import read_table, source_state
from ..streaming import score as streaming
from .data import PaymentData

Query = Callable[[SparkSession, str], DataFrame]


def _on_fixture(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(PaymentData.from_testdata(spark, sf_dir), **kw)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _on_load(fn, part: str | None = None) -> Query:
    """A query over the ingest pipeline (staging -> transactions -> cases)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loaded = ingest.loaded_from_testdata(spark, sf_dir)
        return fn(getattr(loaded, part)) if part else fn(loaded)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _timed(fn: Query, *columns: str) -> Query:
    return lambda spark, sf_dir: _texted(*columns)(fn(spark, sf_dir))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging rows written in the delivered file layout and read back by the declared-schema CSV reader."""
    path = checkpoint_path(spark, f"csv/{uuid.uuid4().hex}")
    write_card_csv(fixtures.raw_card_file(read_table(spark, sf_dir, "events")), path)
    return read_card_csv(spark, path)


def _sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function with positional, named and default arguments."""
    name = params.register_sql_function(PaymentData.from_testdata(spark, sf_dir))
    return spark.sql(f"SELECT * FROM {name}(2, end_hour => 6)")


def _catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the load published as schema-qualified catalog tables and scanned by name."""
    catalog.publish(ingest.loaded_from_testdata(spark, sf_dir), checkpoint_path(spark, f"catalog/{uuid.uuid4().hex}"))
    return ingest.validate_counts(catalog.read_published(spark))


#: the events before this time are the first of two delivered files
SECOND_FILE = "2024-01-16 00:00:00"


_APPENDED: dict = {}


def _appended(spark: SparkSession, sf_dir: str) -> str:
    """The folder where two files were appended, the first of them twice; once per session and state of the source."""
    key = (sf_dir, source_state(spark, sf_dir, "events"))
    known = _APPENDED.get(key)
    if known is None or known[0] is not spark:
        path = checkpoint_path(spark, f"appended/{uuid.uuid4().hex}")
        events = read_table(spark, sf_dir, "events")
        early = F.col("ts") < F.lit(SECOND_FILE).cast("timestamp_ntz")
        files = {"file1": events.where(early), "file2": events.where(~early)}
        for batch in ("file1", "file2", "file1"):
            append.append_batch(ingest.staging_of(files[batch]), path, batch, as_of=TEST_LOAD_TIME)
        _APPENDED[key] = known = (spark, path)
    return known[1]


def _append_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions with their cases after two files were appended, the first of them twice."""
    path = _appended(spark, sf_dir)
    loaded = append.read_appended(spark, path)
    cases = loaded.fraud_cases.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if("is_fraud").alias("fraud_count"), F.min("case_id").alias("first_case_id"))
    out = loaded.transactions.select("transaction_id", "batch_id", "transaction_time", "amount", "v1", "v27").join(cases, "transaction_id", "left")
    return out.fillna(0, ["case_count", "fraud_count", "first_case_id"])


def _incremental_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly, segment and dashboard views over two appended files, merged from the counts of each."""
    path = _appended(spark, sf_dir)
    view_state.update(spark, path)
    parts = {
        "fraud_hourly_stats": (view_state.hourly_stats(spark, path), "hour_of_day", "total_transactions", "fraud_count",
                               "fraud_rate_percentage", "fraud_distribution_percentage"),
        "segment_performance": (view_state.segment_performance(spark, path, include_timestamp=False), "segment", "transactions", "fraud_count",
                                "fraud_rate", "loss_rate"),
        "executive_dashboard": (view_state.executive_dashboard(spark, path, include_timestamp=False), F.lit("all"), "total_transactions",
                                "fraud_cases", "fraud_rate", "loss_percentage"),
    }
    names = ("item", "transactions", "fraud_count", "fraud_rate", "share")
    types = ("string", "long", "long", "double", "double")
    return functools.reduce(DataFrame.unionByName, [
        view.select(F.lit(name).alias("view_name"), *[(F.col(c) if isinstance(c, str) else c).cast(t).alias(n) for c, t, n in zip(columns, types, names)])
        for name, (view, *columns) in parts.items()])


_VIEW_TABLES: dict = {}


def _stored_view(name: str, *stamps: str) -> Query:
    """A view kept in the catalog over published tables, read by qualified name from another session."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = PaymentData.from_testdata(spark, sf_dir)
        prefix = _VIEW_TABLES.get(id(data))
        if prefix is None or prefix[0] is not data:
            prefix = _VIEW_TABLES[id(data)] = (data, f"v{uuid.uuid4().hex[:8]}_")
            tables = ingest.Loaded(None, data.transactions, data.fraud_cases)
            catalog.publish(tables, checkpoint_path(spark, f"catalog/{uuid.uuid4().hex}"), prefix[1])
            catalog.create_views(spark, prefix[1], as_of=TEST_LOAD_TIME)
        other = spark.newSession()
        other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        return _texted(*stamps)(other.table(f"{prefix[1]}{view_sql.SCHEMA}.{name}"))

    return run


def _catalog_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemas that exist after a load was published, and the staging rows before and after it was truncated and dropped."""
    prefix = f"c{uuid.uuid4().hex[:8]}_"
    catalog.publish(ingest.loaded_from_testdata(spark, sf_dir), checkpoint_path(spark, f"catalog/{uuid.uuid4().hex}"), prefix)
    staging = catalog.qualified("staging", prefix)
    schemas = catalog.verify_schemas(spark, prefix).select(
        F.lit("schema").alias("step"), F.expr(f"substring(schema_name, {len(prefix) + 1})").alias("object_name"), F.lit(None).cast("long").alias("row_count"))
    seen = [("published", spark.table(staging).count())]  # counted here: the next statements change the table
    catalog.truncate_staging(spark, prefix)
    seen.append(("truncated", spark.table(staging).count()))
    catalog.drop_staging(spark, prefix)
    seen.append(("dropped", None if not spark.catalog.tableExists(staging) else spark.table(staging).count()))
    rows = spark.createDataFrame([(step, catalog.TABLES["staging"], n) for step, n in seen], schemas.schema)
    return schemas.unionByName(rows).withColumn("row_count", F.coalesce("row_count", F.lit(-1)))


def _view_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per view in a dated snapshot of all views."""
    path = checkpoint_path(spark, f"snapshots/{uuid.uuid4().hex}")
    data = PaymentData.from_testdata(spark, sf_dir)
    views.snapshot_views(data, path, TEST_LOAD_TIME)
    parts = [spark.read.parquet(f"{path}/{v}").groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date"))
             .agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(v).alias("view_name"), "snapshot_date", "row_count")
             for v in sorted(views.VIEW_BUILDERS)]
    return functools.reduce(DataFrame.unionByName, parts)


def _texted(*columns: str):
    """The table with its times as text (the same in every client)."""
    def run(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})

    return run


def engine_neutral(df: DataFrame, drop: tuple[str, ...] = (), sparse: tuple[str, ...] = ()) -> DataFrame:
    """The driver-facing form of a result: DECIMAL columns and integer columns
    with gaps (``sparse``) as DOUBLE (exact conversion, identical on every
    engine and client), always-NULL columns left out."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) or f.name in sparse else F.col(f.name)
            for f in df.schema.fields if f.name not in drop]
    return df.select(*cols)


def _neutral(fn: Query, drop: tuple[str, ...] = (), sparse: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_neutral(fn(spark, sf_dir), drop, sparse)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


_NATIVE: dict[str, Query] = {
    # file 01: ingest and validation
    "ingest_staging": lambda spark, sf_dir: ingest.staging_from_testdata(spark, sf_dir),
    "load_transactions": _on_load(_texted("created_at"), "transactions"),
    "dq_not_null": _on_load(ingest.dq_not_null),
    "dq_unique_key": _on_load(ingest.dq_unique_key),
    "dq_orphans": _on_load(ingest.dq_orphans),
    "load_fraud_cases": _on_load(_texted("reported_date"), "fraud_cases"),
    "validate_counts": _on_load(ingest.validate_counts),
    "fraud_distribution": _on_load(ingest.fraud_distribution, "fraud_cases"),
    # file 02: detection
    "fraud_overview": _on_fixture(detect.fraud_overview),
    "amount_threshold_sweep": _on_fixture(detect.amount_threshold_sweep),
    "amount_flagged_top50": _on_fixture(detect.amount_flagged_top),
    "hourly_fraud": _on_fixture(views.hourly_fraud),
    "zscore_threshold_sweep": _on_fixture(detect.zscore_threshold_sweep),
    "zscore_outliers_top50": _on_fixture(detect.zscore_outliers_top),
    "v3_pattern_top100": _on_fixture(detect.v3_pattern_top),
    "method_comparison": _on_fixture(detect.method_comparison),
    "view_fraud_hourly_stats": _on_fixture(views.fraud_hourly_stats),
    "view_high_risk_transactions": _timed(_on_fixture(views.high_risk_transactions, as_of=TEST_LOAD_TIME), "analysis_timestamp"),
    "view_detection_performance": _on_fixture(views.detection_performance_summary),
    "analyze_fraud_by_parameters": _on_fixture(params.analyze_fraud_by_parameters),
    "analyze_fraud_by_parameters_2_6_12": _on_fixture(params.analyze_fraud_by_parameters, start_hour=2, end_hour=6,
                                                      v3_threshold=12.0),
    # file 03: reporting
    "executive_summary": _on_fixture(report.executive_summary),
    "hourly_financials": _on_fixture(report.hourly_financials),
    "financial_impact": _on_fixture(report.financial_impact),
    "segment_analysis": _on_fixture(report.segment_analysis),
    "period_trends": _on_fixture(report.period_trends),
    "operational_insights": _on_fixture(report.operational_insights),
    "view_executive_dashboard": _timed(_on_fixture(views.executive_dashboard, as_of=TEST_LOAD_TIME), "report_timestamp"),
    "view_segment_performance": _timed(_on_fixture(views.segment_performance, as_of=TEST_LOAD_TIME), "report_timestamp"),
    # connectors and SQL surface
    "csv_ingest_round_trip": _csv_round_trip,
    "sql_table_function": _sql_function,
    "catalog_scan": _catalog_scan,
    "view_snapshots": _view_snapshots,
    "append_load": _append_load,
    "incremental_views": _incremental_views,
    "catalog_lifecycle": _catalog_lifecycle,
    "stored_view_fraud_hourly_stats": _stored_view("fraud_hourly_stats"),
    "stored_view_high_risk_transactions": _stored_view("high_risk_transactions", "analysis_timestamp"),
    "stored_view_detection_performance_summary": _stored_view("detection_performance_summary"),
    "stored_view_executive_dashboard": _stored_view("executive_dashboard", "report_timestamp"),
    "stored_view_segment_performance": _stored_view("segment_performance", "report_timestamp"),
    # extensions
    "detector_extras": _on_fixture(detect.detector_extras),
    "customer_rollup": _timed(_on_fixture(extras.customer_rollup, as_of=TEST_LOAD_TIME, epoch=TEST_LOAD_TIME),
                              "created_date", "last_transaction_date"),
    "v3_profile": _on_fixture(extras.v3_profile),
    "amount_percentiles": _on_fixture(extras.amount_percentiles),
    "hourly_amount_percentiles": _on_fixture(extras.hourly_amount_percentiles),
    "amount_flagged_ranked": _on_fixture(detect.amount_flagged_ranked),
    "outlier_dominance": _on_fixture(extras.outlier_dominance),
    # streaming (file stream of the events table, run to completion)
    "stream_score": streaming.stream_score_testdata,
    "stream_hourly_alerts": streaming.stream_hourly_alerts_testdata,
    "stream_rule_episodes": streaming.stream_rule_episodes_testdata,
}

# results with their library types (DECIMAL money and ratios)
NATIVE_QUERIES = _NATIVE

_SPARSE = {"ingest_staging": ("class",), "csv_ingest_round_trip": ("class",)}  # a row without a class
# always NULL after a load
_DROPPED = {"load_transactions": ("customer_id", "transaction_timestamp"), "load_fraud_cases": ("customer_id", "resolved_date")}
QUERIES: dict[str, Query] = {name: _neutral(fn, _DROPPED.get(name, ()), _SPARSE.get(name, ())) for name, fn in _NATIVE.items()}
