"""Percent rank of every row without a single-partition window.

``PERCENT_RANK() OVER (ORDER BY x)`` is (rows below) / (rows - 1), the same for
all rows of one value. So the rows are counted per distinct value first
(map-side combined: a hot value is one row afterwards), the distinct values are
range-partitioned and written (``ids.materialize_ordered``), each range sums up
its counts in order, and a range's offset is the sum of the ranges before it (one
row per range). The result, one row per distinct value, is joined back to the
rows by value: the side of the ranks has one row a value, so AQE can split a value
that many rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up_ratio
from .ids import materialize_ordered


def rows_below(df: DataFrame, value: str) -> DataFrame:
    """(value, _below, _rows): per distinct value the rows with a smaller one, and all rows; NULL is the largest."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ordered = materialize_ordered(counts, [F.col(value).asc_nulls_last()])
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy("_pid").agg(F.sum("_c").alias("_size"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = ranges.select("_pid", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
                            F.sum("_size").over(Window.partitionBy()).alias("_rows"))
    return (ordered.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_pid").select(value, (F.col("_offset") + F.col("_in")).alias("_below"), "_rows"))


def with_percent_ranks(df: DataFrame, value: str, out: str, scale: int = 2) -> DataFrame:
    """Add ``out`` = ROUND(percent_rank() over (order by value) * 100, scale) to every row; 0 for a single row."""
    ranks = rows_below(df, value).withColumnRenamed(value, "_value")
    joined = df.join(ranks, F.col(value).eqNullSafe(F.col("_value")))
    pct = F.when(F.col("_rows") == 1, F.lit(0).cast(f"decimal(18,{scale})")).otherwise(
        half_up_ratio(F.col("_below"), F.col("_rows") - 1, scale, factor=100))
    return joined.select(*df.columns, pct.alias(out))
