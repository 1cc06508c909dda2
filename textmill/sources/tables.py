"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_corpus(spark: SparkSession, directory: str, name: str, id_col: str, *columns: str) -> DataFrame:
    """The named columns of a table.

    ``textmill.input.partitions`` (a session setting, unset by default) deals the rows
    to so many partitions by id: for small files of one row group, which would be one
    task.  Large inputs have splits to spare and are read as they lie.
    """
    rows = read_table(spark, directory, name).select(id_col, *columns)
    partitions = spark.conf.get("textmill.input.partitions", None)
    return rows.repartition(int(partitions), id_col) if partitions else rows
