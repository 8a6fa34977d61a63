"""Data-quality checks standing in for enforced constraints.

Parquet tables in Spark accept NULLs in NOT NULL columns and have no primary
or foreign keys, so the constraints of the data model are checked by jobs:
null counts (one aggregate), key uniqueness (grouped count with partial
aggregation, so a hot key costs nothing extra) and referential integrity in
both directions (one full outer join of per-key counts instead of two anti
joins of raw rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import rows_from_one


def null_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    return rows_from_one(one, ["table_name", "column_name", "null_count"],
                         [(table, c, F.col(f"_n{i}")) for i, c in enumerate(columns)])


def duplicate_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    """One row: how many key values occur more than once, and in how many rows."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(key).alias("key_column"),
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("rows_with_duplicate_key"),
    )


def orphan_rows(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent row (a foreign-key violation)."""
    return children.join(parents.select(key), key, "left_anti")


def referential_counts(children: DataFrame, parents: DataFrame, key: str,
                       child_name: str, parent_name: str) -> DataFrame:
    """Two rows: children whose (non-NULL) key has no parent, and parents
    without any child.

    Each side is first reduced to one row per key with its row count (partial
    aggregation, so a key holding a large share of all rows collapses on the
    map side); only then are the two keyed counts full-outer-joined. Joining
    the raw rows instead would buffer every row of a hot key in one task.
    A NULL foreign key is not a violation (as in SQL), so it is not counted.
    """
    c = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_nc"))
    p = parents.groupBy(key).agg(F.count(F.lit(1)).alias("_np"))
    one = c.join(p, key, "full_outer").agg(
        F.coalesce(F.sum(F.when(F.col("_np").isNull(), F.col("_nc"))), F.lit(0)).alias("_orphans"),
        F.coalesce(F.sum(F.when(F.col("_nc").isNull(), F.col("_np"))), F.lit(0)).alias("_childless"),
    )
    return rows_from_one(one, ["check_name", "row_count"], [
        (f"{child_name} without {parent_name}", F.col("_orphans")),
        (f"{parent_name} without {child_name}", F.col("_childless")),
    ])
