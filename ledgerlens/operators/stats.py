"""Whole-table statistics attached to every row, and z-scores.

``AVG(x) OVER ()`` / ``STDDEV(x) OVER ()`` written literally becomes a Window
over a single partition: every fact row is moved to one task. Here the
statistics are one global aggregate instead (partial aggregation on every
partition, a final merge of one small row per partition), and the single
result row is broadcast to the fact rows with a cross join. The broadcast
side is exactly one row by construction, whatever the data size, so the
fact side is never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_col(c: str) -> str:
    return f"_mean_{c}"


def sd_col(c: str) -> str:
    return f"_sd_{c}"


def column_stats(df: DataFrame, columns: Iterable[str], *extra: Column) -> DataFrame:
    """One row: mean and sample standard deviation (n-1) of each column, in
    DOUBLE, plus any ``extra`` aggregates (same pass). The sample deviation is
    NULL for fewer than two rows. Sums of doubles depend on their order in the
    last digits, so a row whose score equals a threshold to some fifteen digits
    may fall on either side in another file layout."""
    aggs = list(extra)
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(mean_col(c)), F.stddev_samp(x).alias(sd_col(c))]
    return df.agg(*aggs)


def moments(c: str) -> Column:
    """Count, mean and population variance of a column within a group, as one struct that ``merged_stats`` takes."""
    x = F.col(c).cast("double")
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def merged_stats(groups: DataFrame, columns: Iterable[str], *extra: Column) -> DataFrame:
    """``column_stats`` of all rows from each group's ``moments`` (columns of the
    same names), plus ``extra`` aggregates of the groups. For few groups: their
    means are spread around the common mean in one partition."""
    everywhere = Window.partitionBy()
    aggs = list(extra)
    for c in columns:
        n, mean = F.col(f"{c}.n"), F.col(f"{c}.mean")
        groups = groups.withColumn(f"_all_{c}", F.sum(n * mean).over(everywhere) / F.nullif(F.sum(n).over(everywhere), F.lit(0)))
        apart = F.sum(n * (F.col(f"{c}.var") + F.pow(mean - F.col(f"_all_{c}"), F.lit(2.0))))
        aggs += [F.first(f"_all_{c}").alias(mean_col(c)), F.when(F.sum(n) > 1, F.sqrt(apart / (F.sum(n) - 1))).alias(sd_col(c))]
    return groups.agg(*aggs)


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the one-row statistics to every row (broadcast nested-loop join
    whose build side is the single aggregate row)."""
    return df.crossJoin(F.broadcast(stats))


def zscore(c: str) -> Column:
    """``|x - mean| / NULLIF(sd, 0)`` using the attached statistics; NULL when
    the deviation is 0 or undefined."""
    return F.abs(F.col(c).cast("double") - F.col(mean_col(c))) / F.nullif(F.col(sd_col(c)), F.lit(0.0))
