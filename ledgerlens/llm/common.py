"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_path

#: one run of ASCII white space, as every word contract of this subpackage states it
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and return the stored table.

    Cuts lineage: a lost executor makes later stages re-read files instead of
    repeating the work, and values such as row ids are fixed by the write.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def smallest_id(doc_id: Column, *rest: Column) -> Column:
    """Sort key under which ``min`` prefers the smallest id and a null id loses to any."""
    return F.struct(doc_id.isNull().alias("absent"), doc_id.alias("id"), *rest)


def keep_one_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (any) per key; other rows of the key go. Map-side combined."""
    cols = df.columns
    packed = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
                       F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    one = packed.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.any_value("__row").alias("__row"))
    return one.select("__row.*")


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers (as ``--py-files`` would), once per application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # read by the driver alone, which serves it
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return df
