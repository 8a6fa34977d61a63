"""The delivered card-transaction file: header CSV, 31 columns.

Read with a declared schema (never inferred) and FAILFAST, so a malformed
row stops the load instead of becoming NULLs, or with malformed rows set apart
(``read_card_csv_with_rejects``); then renamed to the staging
layout (Time -> time_seconds, V1..V28 -> v1..v28, Amount -> amount,
Class -> class). Splittable: every executor reads its own byte ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CSV_FILE, FEATURES, STAGING


def to_staging(df: DataFrame) -> DataFrame:
    """Map the file's column names onto the staging table and cast to its
    declared types."""
    renames = {"Time": "time_seconds", "Amount": "amount", "Class": "class", **{v.upper(): v for v in FEATURES}}
    return df.select(
        *[F.col(src).cast(STAGING[dst].dataType).alias(dst) for src, dst in renames.items() if dst in STAGING.names]
    ).select(*STAGING.names)


def read_card_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(CSV_FILE)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )
    return to_staging(raw)


def read_card_csv_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(staging rows, rejected rows as (file, line, reason)): every line of the
    file but headers and empty lines is in exactly one of the two. A line is rejected for its number of
    fields or for a field that its declared type cannot hold; an empty field is
    NULL, not a reject."""
    bad = "_malformed"
    layout = T.StructType([*CSV_FILE.fields, T.StructField(bad, T.StringType())])
    header = ",".join(CSV_FILE.names)
    lines = spark.read.text(path).select(F.input_file_name().alias("_file"), F.rtrim(F.col("value"), F.lit("\r")).alias("_line")).where(
        (F.length("_line") > 0) & (F.replace(F.col("_line"), F.lit('"'), F.lit("")) != header))
    parsed = F.from_csv("_line", layout.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    raw = lines.select("_file", "_line", parsed.alias("_row")).select("_file", "_line", "_row.*")
    fields = F.split(F.col("_line"), ",", -1)
    unreadable = [
        F.when(F.col(c).isNull() & (F.trim(F.get(fields, F.lit(i)), F.lit(' "')) != ""), F.lit(f"{c} is not {CSV_FILE[c].dataType.simpleString()}"))
        for i, c in enumerate(CSV_FILE.names)
    ]
    reason = F.when(F.size(fields) != len(CSV_FILE.names), F.concat(F.size(fields).cast("string"), F.lit(f" fields instead of {len(CSV_FILE.names)}")))
    rejected = raw.where(F.col(bad).isNotNull()).select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), F.coalesce(reason, *unreadable, F.lit("malformed")).alias("reason"))
    return to_staging(raw.where(F.col(bad).isNull())), rejected


def write_card_csv(file_layout: DataFrame, path: str) -> None:
    """Write rows in the delivered layout (Time, V1..V28, Amount, Class)."""
    file_layout.select(*CSV_FILE.names).write.mode("overwrite").option("header", True).csv(path)
