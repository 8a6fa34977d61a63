"""Sharding along a Hilbert curve.

Several metadata columns are quantised into cells of about equal population,
the cells' place on the Hilbert curve orders the rows, and the ordered rows are
cut into runs of equal row count. Neighbours on the curve are close in every
dimension, so each run (one shard, one set of files) covers a small box and a
filter on any of the dimensions skips most files by their min/max values.

Defined results: a null dimension value falls into cell 0 (before every
value); equal rows are ordered by their input position; an empty table gives
an empty result; extra columns, whatever their names, are carried through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import ship, store

#: bits per dimension; 2**bits cells each
BITS = 5
#: rows that one range partition of the global sort holds
ROWS_PER_RANGE = 1_000_000


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each point (Skilling's transposed form, 2004)."""
    x = np.array(cells, dtype=np.int64)
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _ordinal(df: DataFrame, name: str):
    """A number in the order of the column's values: numbers as they are, text by its first seven bytes."""
    col = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return col.cast("timestamp").cast("double")
    return col.cast("double")


def with_hilbert(df: DataFrame, dims: list[str], bits: int = BITS, out: str = "hilbert") -> DataFrame:
    """Append the Hilbert index over equi-populated cells of ``dims``.

    The cell bounds are approximate quantiles of all rows: one aggregate with
    map-side sketches whose result is one row of ``dims * (2**bits - 1)`` numbers.
    """
    if not 1 <= len(dims) * bits <= 62:
        raise ValueError("the index must fit 62 bits")
    n = 1 << bits
    steps = [i / n for i in range(1, n)]
    keys = df.select(*[_ordinal(df, d).alias(f"d{i}") for i, d in enumerate(dims)])
    bounds = keys.agg(*[F.percentile_approx(f"d{i}", steps, 20 * n).alias(f"b{i}") for i in range(len(dims))]).first()

    def cell(i: int, name: str):
        cuts = sorted({float(v) for v in (bounds[i] or [])})
        if not cuts:
            return F.lit(0)
        v = _ordinal(df, name)
        return F.when(v.isNull(), F.lit(0)).otherwise(
            F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda acc, c: acc + (c <= v).cast("int")))

    @F.pandas_udf("long")
    def place(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], bits))

    packed = F.struct(*[cell(i, d).alias(f"c{i}") for i, d in enumerate(dims)])
    return ship(df).withColumn(out, place(packed))


def cut_runs(df: DataFrame, order: list[str], shards: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Append ``shard`` (0..shards-1, row counts at most one apart) and the gapless ``slot`` within it.

    A distributed sort without a single-task window: range partitions in curve
    order are written once, counted, and each row's global rank is its
    partition's offset (a table of one row per partition) plus its place in it.
    The input position breaks ties, so a value that a third of all rows share is
    cut over several partitions.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    placed = store(df.withColumn("__pos", F.monotonically_increasing_id()), "hilbert-rows")
    total = placed.count()
    ranges = max(2 * shards, -(-total // rows_per_range))
    keys = [F.col(f"`{c}`") for c in order] + [F.col("__pos")]
    ordered = store(
        placed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id()), "hilbert-order")
    part = F.shiftright("__mid", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    n = max(total, 1)
    start = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return (ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn("__rank", rank)
            .withColumn("shard", F.expr(f"CAST((__rank * {shards}) DIV {n} AS INT)"))
            .withColumn("slot", F.col("__rank") - start)
            .drop("__part", "__before", "__rank", "__mid", "__pos"))


def write_shards(df: DataFrame, path: str, dims: list[str]) -> DataFrame:
    """Write the rows of ``cut_runs`` as one folder per shard, in slot order, and return the
    manifest: per shard its rows and the min/max of every dimension."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest(df, dims)


def manifest(df: DataFrame, dims: list[str]) -> DataFrame:
    return df.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        *[f(f"`{d}`").alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))])


def prune(shards: DataFrame, dim: str, low, high) -> DataFrame:
    """Shards of a manifest that can hold a value of ``dim`` in [low, high]."""
    return shards.filter((F.col(f"`max_{dim}`") >= F.lit(low)) & (F.col(f"`min_{dim}`") <= F.lit(high)))
