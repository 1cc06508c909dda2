"""Stratified splits and folds, exact and reproducible.

The order inside a label is the MD5 of (seed, row id), so the result does not
depend on partitioning, and SQL can restate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.exprs import hash_hex
from textmill.session import materialize

_BUCKET_DIGITS = 3


def stratified_rank(
    df: DataFrame,
    id_col: str,
    label_col: str,
    seed: int = 42,
    bucket_digits: int = _BUCKET_DIGITS,
) -> DataFrame:
    """Adds ``label_rank`` (1..n in hash order within the label) and ``label_n``.

    The same numbers as ``row_number() over (partition by label order by hash)``,
    but no task ever sees a whole label.  The leading hash digits cut each label
    into 16^digits even buckets; buckets are counted (with map-side combining),
    running totals are taken over the counts, and rows are ranked within their
    bucket only.  The counts are stored first, so the planner knows their size.
    """
    h = hash_hex(seed, F.col(id_col))
    keyed = df.withColumn("_hash", h).withColumn("_bucket", F.substring("_hash", 1, bucket_digits))
    keys = [F.col(label_col), F.col("_bucket")]
    sizes = materialize(keyed.groupBy(*keys).agg(F.count("*").alias("_n")), "bucket-sizes")
    whole = Window.partitionBy(label_col)
    running = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(label_col).alias("_label"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("label_n"),
    )
    within = Window.partitionBy(label_col, "_bucket").orderBy("_hash", id_col)
    ranked = keyed.withColumn("_rn", F.row_number().over(within))
    same = F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))
    return (
        ranked.join(offsets, same)
        .withColumn("label_rank", F.col("_before") + F.col("_rn"))
        .select(*df.columns, "label_rank", "label_n")
    )


def test_quotas(counts: DataFrame, test_size: float = 0.2) -> DataFrame:
    """(label, n) -> (label, n, n_test).

    ceil(rows * test_size) rows are for testing.  The training rows are dealt to
    the labels in proportion, the rest by largest remainder; a label tests on
    what it does not train on.  Integer arithmetic, one row per label.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    base = (
        counts.withColumn("_total", total)
        .withColumn("_train", F.col("_total") - F.ceil(F.col("_total") * F.lit(test_size) - 1e-9))
        .withColumn("_floor", F.floor(F.expr("(n * _train) div _total")))
        .withColumn("_rest", F.col("n") * F.col("_train") % F.col("_total"))
        .withColumn("_spare", F.col("_train") - F.sum("_floor").over(everything))
    )
    by_rest = everything.orderBy(F.desc("_rest"), "label")
    return (
        base.withColumn("_turn", F.row_number().over(by_rest))
        .select(
            "label",
            "n",
            (
                F.col("n") - F.col("_floor") - (F.col("_turn") <= F.col("_spare")).cast("long")
            ).alias("n_test"),
        )
    )


def train_test_split(
    df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``; every label keeps its share on both sides."""
    ids = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    counts = ids.groupBy("label").agg(F.count("*").alias("n"))
    quotas = materialize(test_quotas(counts, test_size), "quotas")
    # Only ids and labels are ranked; the last test row of each label is the cut
    # that every row is compared with, where it lies.
    last = stratified_rank(ids, "_id", "label", seed).join(
        quotas.select(F.col("label").alias("_of"), "n_test"), F.col("label").eqNullSafe(F.col("_of")))
    cuts = materialize(last.filter(F.col("label_rank") == F.col("n_test")).select(
        F.col("label").alias("_label"), F.struct(hash_hex(seed, F.col("_id")), F.col("_id")).alias("_cut")), "cuts")
    order = F.struct(hash_hex(seed, F.col(id_col)), F.col(id_col))
    return (
        df.join(cuts, F.col(label_col).eqNullSafe(F.col("_label")), "left")
        .withColumn("is_test", F.coalesce(order <= F.col("_cut"), F.lit(False)))
        .select(*df.columns, "is_test")
    )


def fold_of(rank: Column | str, k: int) -> Column:
    c = F.col(rank) if isinstance(rank, str) else rank
    return F.pmod(c - 1, F.lit(k)).cast("int")


def stratified_folds(
    df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; the rows of every label are dealt out in turn."""
    ranked = stratified_rank(df, id_col, label_col, seed)
    return ranked.withColumn("fold", fold_of("label_rank", k)).drop("label_rank", "label_n")
