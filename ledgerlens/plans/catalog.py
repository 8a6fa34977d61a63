"""The three schemas of the data model as catalog databases, and the loaded
tables published into them.

``analytics`` holds transactions, ``fraud_detection`` the fraud cases,
``staging`` the landed file. Tables are written with ``saveAsTable`` into the
session's warehouse (cluster storage on a cluster), overwriting so that a
rerun of the load is idempotent. The schema check is a catalog listing, not
an ``information_schema`` query (Spark has none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import ranges_for
from . import view_sql
from .ingest import Loaded

# fixed values: schema and table names of the data model
SCHEMAS = ("analytics", "fraud_detection", "staging")
TABLES = {
    "staging": "staging.raw_creditcard",
    "transactions": "analytics.transactions",
    "fraud_cases": "fraud_detection.fraud_cases",
}


def qualified(part: str, prefix: str = "") -> str:
    return prefix + TABLES[part]


def create_schemas(spark: SparkSession, prefix: str = "") -> None:
    for name in SCHEMAS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{name}")


def verify_schemas(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The model's schemas that exist, one row each (``schema_name``)."""
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("schema_name")).where(
        F.col("schema_name").isin(*[prefix + s for s in SCHEMAS])
    )


def publish(loaded: Loaded, base_path: str | None = None, prefix: str = "", buckets: int | None = None) -> dict[str, str]:
    """Write the loaded tables as catalog tables (overwrite: idempotent), in
    the warehouse or, if given, as external tables under ``base_path``.

    Transactions and fraud cases are stored in equally many buckets by
    ``transaction_id``, sorted, so that their join moves no row. ``buckets``
    follows the size of the tables read (``ranges_for``) unless given; 0 stores
    plain tables. ``prefix`` is put before the schema names.
    """
    spark = loaded.transactions.sparkSession
    create_schemas(spark, prefix)
    if buckets is None:
        buckets = ranges_for(loaded.transactions)
    written = {}
    for part in TABLES:
        table, rows = qualified(part, prefix), getattr(loaded, part)
        if rows is None:
            continue
        if buckets and part != "staging":
            rows = rows.repartition(buckets, "transaction_id")  # one file a bucket
        writer = rows.write.mode("overwrite")
        if buckets and part != "staging":
            writer = writer.bucketBy(buckets, "transaction_id").sortBy("transaction_id")
        if base_path is not None:
            writer = writer.option("path", f"{base_path.rstrip('/')}/{part}")
        writer.saveAsTable(table)
        written[part] = table
    return written


def read_published(spark: SparkSession, prefix: str = "") -> Loaded:
    return Loaded(*(spark.table(qualified(p, prefix)) for p in ("staging", "transactions", "fraud_cases")))


def create_views(spark: SparkSession, prefix: str = "", as_of=None) -> list[str]:
    """Store the five views in the catalog, over the published tables.

    ``CREATE OR REPLACE VIEW`` keeps the text of ``view_sql``: every session of
    the catalog reads them by qualified name, each time over the tables as they
    are then. With a metastore they outlive the application.
    """
    tx, cases = qualified("transactions", prefix), qualified("fraud_cases", prefix)
    labelled = f"(SELECT t.*, c.is_fraud FROM {tx} AS t JOIN {cases} AS c ON t.transaction_id = c.transaction_id)"
    names = []
    for name, definition in view_sql.DEFINITIONS.items():
        names.append(f"{prefix}{view_sql.SCHEMA}.{name}")
        spark.sql(f"CREATE OR REPLACE VIEW {names[-1]} AS " + definition(as_of=as_of).format(labelled=labelled, cases=cases))
    return names


def truncate_staging(spark: SparkSession, prefix: str = "") -> None:
    """Empty the staging table; one under a given path (external), which Spark does not truncate, by overwriting it with no rows."""
    table = qualified("staging", prefix)
    if spark.catalog.getTable(table).tableType == "EXTERNAL":
        spark.createDataFrame([], spark.table(table).schema).write.insertInto(table, overwrite=True)
    else:
        spark.sql(f"TRUNCATE TABLE {table}")


def drop_staging(spark: SparkSession, prefix: str = "") -> None:
    spark.sql(f"DROP TABLE IF EXISTS {qualified('staging', prefix)}")
