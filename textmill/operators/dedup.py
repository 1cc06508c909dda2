"""Exact duplicates: removal, links and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import text_hash


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` becomes a group limit before the shuffle, so each map
    task sends at most one row per key: a key that holds a third of the table
    costs its reducer one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def drop_exact_duplicates(df: DataFrame, text_col: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every raw text.

    The hash leads the key so that sorting compares eight bytes, and the text
    follows it so that a collision never merges two texts.
    """
    return keep_first(df, [F.xxhash64(text_col), F.col(text_col)], order)


def drop_normalized_duplicates(df: DataFrame, text_col: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every text that is equal after normalisation."""
    keyed = df.withColumn("text_hash", text_hash(text_col))
    return keep_first(keyed, ["text_hash"], order)


def count_duplicates(df: DataFrame, text_col: str) -> DataFrame:
    """One row: rows, rows that repeat an earlier text."""
    return (
        df.groupBy(F.xxhash64(text_col), F.col(text_col))
        .count()
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"),
        )
    )


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash).  A null text counts as empty: the key is never null, so
    the planner adds no null check that would hash every text a second time."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text_hash(text).alias("text_hash"))


def duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_hash, first_id, n, n_pairs) for every text that occurs repeatedly."""
    return (
        _keyed(df, id_col, text_col)
        .groupBy("text_hash")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .withColumn("n_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    )


def duplicate_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every repeated row linked to the first row with the same normalised text.

    A group of n copies has n(n-1)/2 pairs, which no cluster can write when a
    third of the table is one text.  The n-1 links hold the same information:
    any two rows with the same ``left_id`` (and that row itself) are a pair, and
    ``duplicate_groups`` counts the pairs in closed form.
    """
    keyed = _keyed(df, id_col, text_col).withColumnRenamed("id", "right_id")
    groups = (
        keyed.groupBy("text_hash")
        .agg(F.min("right_id").alias("left_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return (
        keyed.join(groups, "text_hash")
        .filter("right_id > left_id")
        .select("left_id", "right_id", "text_hash")
    )
