"""Cleaning of loaded corpora, with statistics and an audit of removed rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.labels import detect_mislabel, is_leaf, normalize_label
from textmill.functions.text import strip
from textmill.operators.dedup import drop_exact_duplicates, drop_normalized_duplicates
from textmill.session import materialize


def require_columns(df: DataFrame, required: Sequence[str], name: str = "DataFrame") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(
            f"{name} missing required columns: {missing}. Available columns: {df.columns}"
        )
    return df


def drop_short(df: DataFrame, text_col: str, min_length: int = 100) -> DataFrame:
    """Keep texts of at least ``min_length`` characters without outer whitespace."""
    return df.filter(F.length(strip(text_col)) >= min_length)


def add_normalized_label(df: DataFrame, label_col: str, to: str) -> DataFrame:
    """Adds the canonical label, row by row."""
    return df.withColumn(to, normalize_label(label_col))


def clean_frame(
    df: DataFrame,
    text_col: str,
    order: Sequence[str],
    remove_duplicates: bool = True,
    drop_na: bool = True,
) -> DataFrame:
    """First row per raw text, then only rows without any null."""
    out = drop_exact_duplicates(df, text_col, order) if remove_duplicates else df
    return out.na.drop("any") if drop_na else out


def load_statistics(
    df: DataFrame, text_col: str, label_col: str, order: Sequence[str]
) -> DataFrame:
    """One row about :func:`clean_frame`: rows, duplicates, rows and labels kept."""
    has_null = F.lit(False)
    for c in df.columns:
        has_null = has_null | F.col(c).isNull()
    firsts = drop_exact_duplicates(df, text_col, order)
    after = firsts.agg(
        F.lit(0).cast("long").alias("n_original"),
        F.count("*").alias("n_texts"),
        F.count(F.when(~has_null, 1)).alias("n_cleaned"),
        F.count_distinct(F.when(~has_null, F.col(label_col))).alias("n_labels"),
    )
    zero = F.lit(0).cast("long")
    before = df.agg(
        F.count("*").alias("n_original"),
        zero.alias("n_texts"),
        zero.alias("n_cleaned"),
        zero.alias("n_labels"),
    )
    total = before.unionByName(after).agg(
        *[F.sum(c).alias(c) for c in ("n_original", "n_texts", "n_cleaned", "n_labels")]
    )
    dups = F.col("n_original") - F.col("n_texts")
    return total.select(
        "n_original",
        dups.alias("n_duplicates"),
        F.coalesce(F.try_divide(100.0 * dups, F.col("n_original")), F.lit(0.0)).alias(
            "duplicate_percentage"
        ),
        "n_cleaned",
        "n_labels",
    )


def clean_texts(
    df: DataFrame,
    text_col: str,
    label_col: str,
    order: Sequence[str],
    normalize_labels: bool = True,
    remove_duplicates: bool = True,
    remove_short: bool = True,
    min_length: int = 100,
) -> DataFrame:
    """Short rows out, canonical labels, first row per normalised text."""
    out = drop_short(df, text_col, min_length) if remove_short else df
    if normalize_labels:
        out = add_normalized_label(out, label_col, label_col)
    if remove_duplicates:
        out = drop_normalized_duplicates(out, text_col, order).drop("text_hash")
    return out


class CleanCorpus:
    """``kept`` rows, ``audit`` of the removed ones and one row of ``stats``.

    All of them read one stored table of the tagged rows, and what counts say is told
    from the counts of its labels, a small table; the corpus itself was read once.
    """

    def __init__(self, tagged: DataFrame, per_label: DataFrame, columns: Sequence[str], text_col: str, id_col: str,
                 label_col: str, order: Sequence[str], remove_duplicates: bool):
        self._per_label, self._label_col = per_label, label_col
        common = tagged.filter("_reason is null and not _unlabelled").select(*columns, "normalized_label")
        #: The rows that stay.
        self.kept = drop_exact_duplicates(common, text_col, order) if remove_duplicates else common
        #: (row_id, label, reason) of the rows that go for their label.
        self.audit = tagged.filter("_reason is not null").select(
            F.col(id_col).alias("row_id"),
            F.when(F.col("_suggested").isNotNull(), F.col(label_col)).otherwise(F.col("normalized_label")).alias("label"),
            F.col("_reason").alias("reason"),
        )
        self.unknown = self.kept.select(F.col("normalized_label").alias("label")).distinct().filter(~is_leaf("label"))

    @cached_property
    def stats(self) -> DataFrame:
        """Counts of each stage.  Only what duplicates leave is counted over rows."""
        names = ["original_count", "removed_mislabeled", "removed_rare", "after_rare", "labels_before"]
        before = self._per_label.agg(
            F.sum("n").alias("original_count"), F.sum("n_mislabeled").alias("removed_mislabeled"),
            F.sum(F.when(F.col("_rare") & ~F.col("_unlabelled"), F.col("n_credible")).otherwise(0)).alias("removed_rare"),
            F.sum(F.when(~F.col("_rare") & ~F.col("_unlabelled"), F.col("n_credible")).otherwise(0)).alias("after_rare"),
            F.count_distinct(self._label_col).alias("labels_before"))
        # One row for each label that is left, then one row.
        after = self.kept.groupBy("normalized_label").agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("final_count"), F.count("normalized_label").alias("labels_after"))
        both = before.select(*[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]).crossJoin(after)
        return both.select(
            "original_count",
            "removed_mislabeled",
            F.col("removed_rare").alias("removed_rare_labels"),
            (F.col("after_rare") - F.col("final_count")).alias("removed_duplicates"),
            "final_count",
            "labels_before",
            "labels_after",
        )


def clean_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    order: Sequence[str] | None = None,
    remove_mislabeled: bool = True,
    remove_rare_labels: bool = True,
    min_rows_per_label: int = 20,
    remove_duplicates: bool = True,
) -> CleanCorpus:
    """Normalise labels, drop mislabelled rows, rare labels and duplicate texts.

    Label counts are taken after the mislabelled rows are gone and before
    duplicates are, so a label that is kept may end with fewer rows than the
    minimum.  Where rare labels go, rows without a label go as well, unaudited.  One pass judges the rows and stores them; the counts (one row per pair of
    a label and its normal form) are taken from the stored labels, and tag the rows as
    a table of known size, so texts are not shuffled by label.
    """
    order = list(order or [id_col])
    suggested = (
        detect_mislabel(text_col, label_col) if remove_mislabeled else F.lit(None).cast("string")
    )
    judged = materialize(add_normalized_label(df, label_col, "normalized_label").withColumn("_suggested", suggested), "judged")
    per_pair = judged.groupBy(F.col(label_col), "normalized_label").agg(
        F.count("*").alias("n"), F.count("_suggested").alias("n_mislabeled"))
    credible = F.sum(F.col("n") - F.col("n_mislabeled")).over(Window.partitionBy("normalized_label"))
    unlabelled = F.col("normalized_label").isNull() & F.lit(remove_rare_labels)
    per_label = materialize(per_pair.withColumn("_unlabelled", unlabelled).withColumn("n_credible", F.col("n") - F.col("n_mislabeled")).withColumn(
        "_rare", (credible < min_rows_per_label) & F.lit(remove_rare_labels)), "label-counts")
    rare = materialize(per_label.filter("_rare and normalized_label is not null").select(F.col("normalized_label").alias("_label")).distinct(), "rare-labels")
    tagged = judged.join(rare, F.col("normalized_label") == F.col("_label"), "left").withColumn("_unlabelled", unlabelled).withColumn(
        "_reason", F.when(F.col("_suggested").isNotNull(), F.concat(F.lit("mislabeled, suggested: "), F.col("_suggested"))).when(
            F.col("_label").isNotNull(), F.lit("tiny category")))
    return CleanCorpus(tagged, per_label, df.columns, text_col, id_col, label_col, order, remove_duplicates)
