"""Tables between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.session import materialize


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: later steps, and
    tasks of lost executors, start from the files."""
    return materialize(df, name)
