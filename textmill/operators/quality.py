"""Quality of a labelled corpus: metrics, conflicts, score and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import sample_prefix, strip, text_hash


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _per_text(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """One fixed-width row per distinct normalised text.

    All text metrics follow from it, so the texts are read and hashed once and
    only counters are shuffled.  Two labels differ somewhere in a group exactly
    when its smallest and largest label differ, hence no distinct count.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        text_hash(text).alias("text_hash"),
        F.length(text).alias("length"),
        (F.length(strip(text)) == 0).cast("long").alias("empty"),
        F.col(label_col).alias("label"),
    )
    return rows.groupBy("text_hash").agg(
        F.count("*").alias("n"),
        F.sum("length").alias("chars"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
        F.sum((F.col("length") < 100).cast("long")).alias("short"),
        F.sum("empty").alias("empty"),
        F.min("label").alias("label_lo"),
        F.max("label").alias("label_hi"),
    )


def quality_metrics(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """One row with fifteen metrics of texts and labels."""
    n, total = F.col("n"), F.sum("n")
    texts = _per_text(df, id_col, text_col, label_col).agg(
        _zero(total).alias("total_rows"),
        F.count("*").alias("unique_texts"),
        _zero(total - F.count("*")).alias("duplicate_texts"),
        F.coalesce(F.try_divide(100.0 * (total - F.count("*")), total), F.lit(0.0)).alias(
            "duplicate_percentage"
        ),
        F.coalesce(F.try_divide(F.sum("chars"), total), F.lit(0.0)).alias("avg_length"),
        _zero(F.min("shortest")).alias("min_length"),
        _zero(F.max("longest")).alias("max_length"),
        _zero(F.sum("short")).alias("short_texts"),
        _zero(F.sum("empty")).alias("empty_texts"),
        _zero(F.sum((n * (n - 1) / 2).cast("long"))).alias("exact_duplicate_pairs"),
        _zero(F.sum((F.col("label_lo") != F.col("label_hi")).cast("long"))).alias(
            "label_conflicts"
        ),
    )
    labels = (
        df.groupBy(F.col(label_col))
        .count()
        .agg(
            F.count("*").alias("unique_labels"),
            _zero(F.min("count")).alias("min_rows_per_label"),
            _zero(F.max("count")).alias("max_rows_per_label"),
            F.coalesce(
                F.try_divide(F.max("count").cast("double"), F.min("count").cast("double")),
                F.lit(float("inf")),
            ).alias("imbalance_ratio"),
        )
    )
    # Two one-row results become one row: every column is null in one of them.
    both = texts.unionByName(labels, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in METRICS])


METRICS = [
    "total_rows", "unique_texts", "duplicate_texts", "duplicate_percentage",
    "unique_labels", "avg_length", "min_length", "max_length", "short_texts",
    "empty_texts", "exact_duplicate_pairs", "label_conflicts",
    "min_rows_per_label", "max_rows_per_label", "imbalance_ratio",
]


def with_quality_score(metrics: DataFrame) -> DataFrame:
    """Adds ``quality_score`` (0-100) and its verdict."""

    def penalty(condition: Column, points: Column | int) -> Column:
        cost = F.lit(points) if isinstance(points, int) else points
        return F.when(condition, cost).otherwise(0)

    lost = (
        penalty(F.col("duplicate_percentage") > 10, 20)
        + penalty(F.col("label_conflicts") > 0, 10 * F.least(F.col("label_conflicts"), F.lit(5)))
        + penalty(F.col("short_texts") > F.col("total_rows") * 0.05, 10)
        + penalty(F.col("imbalance_ratio") > 10, 15)
    )
    score = F.greatest(F.lit(0), 100 - lost).cast("long")
    return metrics.withColumn("quality_score", score).withColumn(
        "verdict",
        F.when(F.col("quality_score") >= 80, "good")
        .when(F.col("quality_score") >= 60, "needs attention")
        .otherwise("cleaning recommended"),
    )


def quality_report(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    return with_quality_score(quality_metrics(df, id_col, text_col, label_col))


def with_quality_status(metrics: DataFrame) -> DataFrame:
    """Adds Good / Acceptable / Poor and the flags of its two causes."""
    total, dup, short = F.col("total_rows"), F.col("duplicate_texts"), F.col("short_texts")
    issues = dup + short

    def flag(n: Column, limit: int) -> Column:
        share = F.try_divide(100.0 * n, total)
        return F.when(n == 0, "none").when(share < limit, "warn").otherwise("bad")

    return metrics.select(
        "total_rows",
        "duplicate_texts",
        "short_texts",
        "unique_labels",
        flag(dup, 20).alias("duplicate_flag"),
        flag(short, 5).alias("short_flag"),
        F.when(issues == 0, "Good")
        .when(issues < total * 0.1, "Acceptable")
        .otherwise("Poor")
        .alias("status"),
    )


def label_conflicts(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Texts that carry more than one label: one row per text.

    (text_hash, first_id, labels, sample, n).  The member rows are a table of
    their own, :func:`conflict_members`, because one text may fill a large part
    of the corpus; here a group keeps its labels, not its rows.
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        text_hash(text_col).alias("text_hash"),
        sample_prefix(text_col).alias("sample"),
    )
    per_label = rows.groupBy("text_hash", "label").agg(
        F.count("*").alias("n"),
        F.min(F.struct("id", "sample")).alias("first"),
    )
    return (
        per_label.groupBy("text_hash")
        .agg(
            F.min("first").alias("first"),
            F.sort_array(F.collect_list("label")).alias("labels"),
            F.sum("n").alias("n"),
        )
        .filter(F.size("labels") > 1)
        .select(
            "text_hash",
            F.col("first.id").alias("first_id"),
            "labels",
            F.col("first.sample").alias("sample"),
            "n",
        )
    )


def conflict_members(df: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text_hash, id, label) of every row whose text carries several labels."""
    rows = df.select(
        text_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
    )
    torn = (
        rows.groupBy("text_hash")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .filter("lo <> hi")
        .select("text_hash")
    )
    return rows.join(torn, "text_hash", "left_semi")


def first_conflicts(conflicts: DataFrame, n: int = 5) -> DataFrame:
    """The first conflicts in corpus order, for the report."""
    return conflicts.orderBy("first_id").limit(n)
