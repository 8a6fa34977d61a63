"""Dense sequential ids in a global order, without a single-partition window.

``row_number() OVER (ORDER BY …)`` without a partition moves every row to
one task. Instead:

1. range-partition on the order keys (sampled bounds split the key space
   evenly; an input-position key ends the order so that even a huge group of
   identical rows is spread over several partitions) and sort within each
   partition;
2. in the same job, tag every row with its partition index and its position
   inside the partition, and write the result as a table in the cluster's
   shared checkpoint folder — the layout is fixed from here on, the lineage
   is cut, and a lost executor re-reads files instead of recomputing the
   input (the input is computed once, not once per pass);
3. count rows per partition (one small row per partition), turn the counts
   into running offsets (a window over #partitions rows), broadcast them
   (bounded by the partition count, not the data) and add each row's
   position.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_path

_POS_MASK = (1 << 33) - 1  # low 33 bits of monotonically_increasing_id = row index in partition


#: bytes of the inputs (as the optimizer knows them) per range of the global sort
BYTES_PER_RANGE = 256 << 20


def ranges_for(df: DataFrame, bytes_per_range: int = BYTES_PER_RANGE) -> int:
    """Ranges that the size of the tables read asks for, at least the session's
    shuffle partitions (also where a size is unknown). The plan's own estimate
    is no measure: without column statistics a join's is the product of its sides."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:  # no JVM plan (Spark Connect)
        return least
    return least if size >= 1 << 60 else max(least, -(-size // bytes_per_range))


def materialize_ordered(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None,
                        path: str | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Range-partition and sort ``df`` and write it with ``_pid`` (partition)
    and ``_pos`` (position in partition); return the written table. ``derived``
    columns are added after the sort: neither sampled nor moved, computed once."""
    spark = df.sparkSession
    n = num_partitions or ranges_for(df)
    path = path or checkpoint_path(spark, f"ordered/{uuid.uuid4().hex}")
    keyed = df.withColumn("_input_pos", F.monotonically_increasing_id())
    keys = [*order, F.col("_input_pos")]
    (
        keyed.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumns({
            "_pid": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)),
            **(derived or {}),
        })
        .drop("_input_pos")
        .write.mode("overwrite").parquet(path)
    )
    return spark.read.parquet(path)


def number_ordered(ordered: DataFrame, id_col: str, start: int = 1) -> DataFrame:
    """Ids from a table written by ``materialize_ordered``."""
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        ordered.join(F.broadcast(offsets), "_pid")
        .withColumn(id_col, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_pid", "_pos", "_offset")
    )


def assign_sequential_ids(df: DataFrame, order: Sequence[Column], id_col: str, start: int = 1,
                          num_partitions: int | None = None, path: str | None = None) -> DataFrame:
    return number_ordered(materialize_ordered(df, order, num_partitions, path), id_col, start)
