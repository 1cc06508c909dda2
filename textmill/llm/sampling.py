"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.tables import stored


def shares(rows: DataFrame, label: str, per_label: int, max_labels: int | None) -> DataFrame:
    """(label, share, short): how much of each label, or of the most frequent ones, is drawn.

    ``rows`` has ``is_short``; a label whose rows have none that is short draws from
    all of them.  The table has a row for each label and is stored, so the planner
    knows its size when the rows are joined with it.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("is_short"), 1)).alias("n_short"))
    counts = counts if max_labels is None else counts.orderBy(F.desc("n"), label).limit(max_labels)
    short = F.col("n_short") > 0
    return stored(counts.select(
        label, F.least(F.lit(1.0), per_label / F.when(short, F.col("n_short")).otherwise(F.col("n"))).alias("share"),
        short.alias("short")), "shares")


def _draw(name: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), name), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(rows: DataFrame, label: str, per_label: int, max_chars: int, max_labels: int | None) -> pd.DataFrame:
    """Some ``per_label`` rows (doc_id, text, label) for each label, or for the ``max_labels`` most frequent.

    A row is taken if the hash of its id is below the share that its label needs, so
    the choice does not depend on partitions; for a row without id, the hash of its text.  Texts of more than ``max_chars`` code
    points are not taken; of a label that has only such texts, their beginnings are
    learned.  Rows without label or text are not taken.  The parameters bound what reaches
    the driver.
    """
    rows = rows.filter(F.col("text").isNotNull()).select("doc_id", "text", label, (F.length("text") <= max_chars).alias("is_short"))
    taken = rows.join(shares(rows, label, per_label, max_labels), label).filter(
        F.when(F.col("doc_id").isNull(), _draw(F.col("text"))).otherwise(_draw(F.col("doc_id"))) < F.col("share")).filter(
        F.col("is_short") | ~F.col("short"))
    return _collected(taken.select("doc_id", F.substring("text", 1, max_chars).alias("text"), label))


def joined_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, max_chars: int,
                  max_labels: int | None) -> pd.DataFrame:
    """The same where the labels (doc_id, label) are a table of their own: labels are
    drawn first, so a table of bounded size is broadcast and no text is moved.  Of
    several labels of an id the smallest counts; long texts are not taken."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(label).alias(label)).withColumn("is_short", F.lit(True))
    taken = one.join(shares(one, label, per_label, max_labels), label).filter(
        _draw(F.col("doc_id")) < F.col("share")).select("doc_id", label)
    rows = taken.collect()
    if not rows:
        return pd.DataFrame({c: [] for c in (*docs.columns, label)})
    few = docs.sparkSession.createDataFrame(rows, taken.schema)
    return _collected(docs.join(F.broadcast(few), "doc_id").filter(F.col("text").isNotNull()).filter(F.length("text") <= max_chars))


def _collected(taken: DataFrame) -> pd.DataFrame:
    return taken.toPandas().sort_values(["doc_id", "text"], ignore_index=True)
