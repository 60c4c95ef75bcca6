"""Readers and writers of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str | list[str], typed: bool = False) -> DataFrame:
    """CSV with a header: all text, so that identifiers keep their digits; ``typed`` infers the columns' types."""
    return spark.read.option("header", True).option("inferSchema", typed).option("multiLine", True).option("escape", '"').csv(path)


def read_csv_filled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV as text with '' for nulls."""
    return read_csv(spark, path).na.fill("")


def read_parts(spark: SparkSession, paths: list[str], columns: bool = True) -> DataFrame:
    """Several files of one source, with the file of each row in ``_file`` if ``columns``."""
    df = read_csv(spark, paths)
    return df.withColumn("_file", F.col("_metadata.file_name")) if columns else df


def table_name(file_name: str, table: str) -> str:
    """The dataset name of one table of a file that holds several."""
    return f"{file_name} ({table})"


def write_export(wide: DataFrame, path: str) -> None:
    """The wide master as CSV with a header, without its size and source columns, in its order."""
    wide.drop("cluster_size", "sources").write.mode("overwrite").option("header", True).csv(path)
