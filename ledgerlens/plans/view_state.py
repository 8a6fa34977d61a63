"""Views kept up to date by partial counts of each batch.

A view that only counts and adds can be merged: the counts of two batches add up to
those of both. ``update`` counts every appended batch once (``append.py``), from its own
folders, into one small table of (hour, amount band) cells and the number of its
fraud cases; ``hourly_stats``, ``segment_performance`` and ``executive_dashboard``
merge those cells and never read a transaction again. Their ratios and labels
are those of the view's one definition (``view_sql.py``).

A batch's state carries the batch's content digest. State counts only where the
ledger names the same batch with the same content, so the state of a batch that was
replaced, or whose load failed, is never read; ``update`` writes it anew. An update
that failed half-way repeats without harm: each batch's state is one overwritten folder.

The high-risk list and the detector comparison are not of this kind: each batch moves
the mean and deviation that every earlier row is measured by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labelled import labelled
from . import view_sql
from .append import read_ledger

_MONEY = T.DecimalType(20, 2)
STATE = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("hour_of_day", T.IntegerType()), T.StructField("place", T.IntegerType()),
    T.StructField("transactions", T.LongType()), T.StructField("fraud", T.LongType()), T.StructField("normal", T.LongType()),
    T.StructField("volume", _MONEY), T.StructField("fraud_volume", _MONEY),
    T.StructField("filed_fraud", T.LongType())])  # set in the batch's own row, which has no cell


def _state_path(base_path: str) -> str:
    return f"{base_path.rstrip('/')}/view_state"


def read_state(spark: SparkSession, base_path: str) -> DataFrame:
    """The cells of all batches whose state is of the content that the ledger has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_state_path(base_path))
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], STATE)
    valid = read_ledger(spark, base_path).select("batch_id", "content")  # one row per delivered file
    return spark.read.schema(STATE).parquet(_state_path(base_path)).select(*STATE.names).join(valid, ["batch_id", "content"], "left_semi")


def count_batch(transactions: DataFrame, cases: DataFrame, batch_id: str, content: str) -> DataFrame:
    """The state of one batch: its cells, and one row with the number of its fraud cases."""
    cells = labelled(transactions, cases).groupBy(F.expr(view_sql.HOUR).alias("hour_of_day"), F.expr(view_sql.PLACE).alias("place")).agg(
        F.count(F.lit(1)).alias("transactions"), F.count_if("is_fraud").alias("fraud"), F.count_if(~F.col("is_fraud")).alias("normal"),
        F.sum("amount").alias("volume"), F.sum(F.when(F.col("is_fraud"), F.col("amount"))).alias("fraud_volume"))
    filed = cases.agg(F.count_if("is_fraud").alias("filed_fraud"))
    both = cells.unionByName(filed, allowMissingColumns=True).withColumns({"batch_id": F.lit(batch_id), "content": F.lit(content)})
    return both.select(*[F.col(f.name).cast(f.dataType) for f in STATE])


def update(spark: SparkSession, base_path: str) -> list[str]:
    """Count the batches that have no state yet; the keys of those that were counted."""
    base = base_path.rstrip("/")
    known = read_state(spark, base).where(F.col("filed_fraud").isNotNull()).select("batch_id")
    todo = read_ledger(spark, base).join(known, "batch_id", "left_anti").orderBy("batch_id").select("batch_id", "content").collect()
    for batch, content in todo:
        tx, cases = (spark.read.parquet(f"{base}/{part}/batch_id={batch}") for part in ("transactions", "fraud_cases"))
        count_batch(tx, cases, batch, content).coalesce(1).write.mode("overwrite").parquet(f"{_state_path(base)}/batch={batch}")
    return [batch for batch, _ in todo]


def _merged(spark: SparkSession, base_path: str) -> DataFrame:
    state = read_state(spark, base_path)
    missing = read_ledger(spark, base_path).join(state.select("batch_id").distinct(), "batch_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} batches under {base_path} have no state; call update first")
    return state


def _total(column: str, money: bool = False) -> str:
    return f"CAST(sum({column}) AS DECIMAL({_MONEY.precision},{_MONEY.scale}))" if money else f"CAST(sum({column}) AS BIGINT)"


def hourly_stats(spark: SparkSession, base_path: str) -> DataFrame:
    hours = (f"(SELECT hour_of_day, {_total('transactions')} AS total_transactions, {_total('fraud')} AS fraud_count, "
             f"{_total('normal')} AS normal_count FROM {{state}} AS cells WHERE filed_fraud IS NULL GROUP BY 1)")
    known = f"(SELECT coalesce({_total('filed_fraud')}, 0) AS n_fraud_cases FROM {{state}} AS batches)"
    return spark.sql(view_sql.fraud_hourly_stats(hours=hours, known=known), state=_merged(spark, base_path))


def segment_performance(spark: SparkSession, base_path: str, as_of=None, include_timestamp: bool = True) -> DataFrame:
    bands = (f"(SELECT place, {_total('transactions')} AS transactions, {_total('fraud')} AS fraud_count, {_total('volume', True)} AS volume, "
             f"{_total('fraud_volume', True)} AS fraud_volume FROM {{state}} AS cells WHERE filed_fraud IS NULL GROUP BY 1)")
    return spark.sql(view_sql.segment_performance(as_of, include_timestamp, bands), state=_merged(spark, base_path))


def executive_dashboard(spark: SparkSession, base_path: str, as_of=None, include_timestamp: bool = True) -> DataFrame:
    totals = (f"(SELECT *, CAST(total_volume / nullif(total_transactions, 0) AS DECIMAL(14,6)) AS avg_transaction FROM ("
              f"SELECT coalesce({_total('transactions')}, 0) AS total_transactions, coalesce({_total('fraud')}, 0) AS fraud_cases, "
              f"{_total('volume', True)} AS total_volume, {_total('fraud_volume', True)} AS fraud_loss "
              f"FROM {{state}} AS cells WHERE filed_fraud IS NULL) AS sums)")
    return spark.sql(view_sql.executive_dashboard(as_of, include_timestamp, totals), state=_merged(spark, base_path))
