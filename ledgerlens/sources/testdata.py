"""Parquet tables of a test-data folder (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table as its files are split; a caller that wants other splits repartitions."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def source_state(spark: SparkSession, sf_dir: str, name: str) -> str:
    """What tells one state of a table's files from another: the top path's length and modification time."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
        return f"{status.getLen()}@{status.getModificationTime()}"
    except AttributeError:  # no JVM gateway (Spark Connect)
        return ""
