"""Saved tables, literal tables, text lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(folder: str, tables: Mapping[str, DataFrame], *, partition_by: Sequence[str] = ()) -> None:
    """Write several named tables, replacing what is there; a partition column that no table has raises."""
    unknown = [c for c in partition_by if not any(c in df.columns for df in tables.values())]
    if unknown:
        raise ValueError(f"no such partition columns: {unknown}")
    for name, df in tables.items():
        parts = [c for c in partition_by if c in df.columns]
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def inline(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A literal table written in code."""
    return spark.createDataFrame(list(rows), schema)


def read_lines(spark: SparkSession, *globs: str, sep: str | None = None) -> DataFrame:
    """All lines of all matching files as rows ``(file, line)``."""
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(list(globs)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
