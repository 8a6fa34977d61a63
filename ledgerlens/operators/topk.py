"""Top-k and the percent rank of the top rows within a large set.

``ORDER BY … LIMIT k`` plans as TakeOrderedAndProject: each partition keeps
its own k best rows and only those reach the final merge, so no full sort or
single-partition shuffle of the input happens.

``PERCENT_RANK() OVER (ORDER BY x)`` over the whole flagged set would be a
single-partition window. For the k top rows (by x descending) it only needs
two numbers per row: n, the size of the set, and the number of rows with a
value >= x. The top rows already are all rows above their lowest value, so
that number is counted among them, except at the lowest value itself: one
aggregate over the set counts n and the rows at or above that one value. The
top rows ride along as one array of <= k records, so they are computed once.
rank = (n - ge) / (n - 1), and 0 when n = 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up_ratio


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def with_percent_rank_of_top(
    population: DataFrame,
    top: DataFrame,
    value: str,
    out: str,
    scale: int = 2,
) -> DataFrame:
    """Add ``out`` = ROUND(percent_rank() over (order by value) * 100, scale)
    to the rows of ``top``, ranked within ``population``.

    ``top`` must hold the rows of ``population`` with the largest ``value``
    (a top-k by ``value`` descending), so every population row with a value
    >= a top row's value has one of the top rows' values.
    """
    packed = top.agg(F.collect_list(F.struct(*top.columns)).alias("_rows"), F.min(value).alias("_low"))  # one row
    counted = (
        population.select(value).crossJoin(F.broadcast(packed))
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value) >= F.col("_low")).alias("_n_low"),
             F.first("_low").alias("_low"), F.first("_rows").alias("_rows"))
    )
    each = counted.select("_n", "_n_low", "_low", "_rows", F.explode("_rows").alias("_r"))
    among_top = F.size(F.filter("_rows", lambda r: r[value] >= F.col("_r")[value]))
    ge = F.when(F.col("_r")[value] == F.col("_low"), F.col("_n_low")).otherwise(among_top)
    pct = F.when(F.col("_n") == 1, F.lit(0).cast(f"decimal(18,{scale})")).otherwise(
        half_up_ratio(F.col("_n") - ge, F.col("_n") - 1, scale, factor=100)
    )
    return each.select("_r.*", pct.alias(out))
