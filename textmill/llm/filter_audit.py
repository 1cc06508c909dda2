"""Interaction of filters: what each filter removes in every order of application.

A document is known by the set of filters that it fails (a bit mask), so a table of
any size shrinks to one count for each part and mask.  Orders are numbered by their
Lehmer rank, that is lexicographically.  Orders that begin alike are neighbours, so
"this mask goes at this step" holds on intervals of ranks: one for every beginning of
filters that the mask passes, followed by one that it fails.  A mask's counts are
added where an interval begins and taken off where it ends; the running sum over the
ranks is the number removed in each order (a difference array).  No order is played.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.words import space_words

#: The filters of :func:`failed_filters`, in the order of their bits.
FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lehmer_rank(beginning: Sequence[int], n: int) -> int:
    """Rank of the first permutation of 0..n-1, in lexicographic order, that begins so."""
    left, rank = list(range(n)), 0
    for k, x in enumerate(beginning):
        rank += left.index(x) * factorial(n - 1 - k)
        left.remove(x)
    return rank


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank): where a document that fails just the filters
    of the mask goes at that step."""
    found = []
    for size in range(1, n + 1):
        for failed in combinations(range(n), size):
            mask, passed = sum(1 << f for f in failed), [f for f in range(n) if f not in failed]
            for step in range(1, len(passed) + 2):
                for before in permutations(passed, step - 1):
                    for f in failed:
                        first = lehmer_rank([*before, f], n)
                        found.append((mask, step, first, first + factorial(n - step)))
    return found


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    rows = [(rank, "".join(order), step, filters.index(letter))
            for rank, order in enumerate(permutations(filters)) for step, letter in enumerate(order, 1)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, filter int")


def failed_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                   min_words: int = 50, min_distinct: int = 65, max_upper: int = 5, symbols: str = "#$%&*|") -> DataFrame:
    """(part, mask, good, toxic) of every row: the bits of the filters that its text fails.

    A: fewer than ``min_words`` words; B: less than ``min_distinct`` per cent of its
    words are distinct; C: more than ``max_upper`` per cent of its characters are A-Z;
    D: it holds one of the symbols; E: a row of a smaller id has the same text.  A
    null text is empty, a null part the empty string.  A row without id fails E never
    and makes no other fail it; rows of one id are no copies of each other.  ``good``
    and ``toxic`` are 1 if any label of the id says so, else 0.

    Texts are not moved: they are known by a digest, and only digests that several
    rows have are joined back.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text")).withColumn("words", space_words(F.col("text")))
    rows = rows.withColumn("n", F.size("words"))
    upper = F.length("text") - F.length(F.translate("text", _UPPER, ""))
    fails: list[Column] = [
        F.col("n") < min_words,
        100 * F.size(F.array_distinct("words")) < min_distinct * F.col("n"),
        100 * upper.cast("long") > max_upper * F.length("text").cast("long"),
        F.length(F.translate("text", symbols, "")) < F.length("text")]
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                       sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).alias("mask"))
    first = rows.filter("doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first")
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc_id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").join(marked, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def filter_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of every part, order and step, zeros included, from (part, mask, good, toxic).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley); bit i of a mask is the i-th of ``filters``.  An empty table
    has no part, hence no row.
    """
    spark, n = masks.sparkSession, len(filters)
    counts = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    # Difference arrays: both tables of orders and of intervals depend on the filters alone.
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, first int, after int")
    sums = ["n", "good", "toxic"]
    ends = counts.join(F.broadcast(intervals), "mask").select(
        "part", "step", F.explode(F.array(
            F.struct(F.col("first").alias("rank"), *sums),
            F.struct(F.col("after").alias("rank"), *[(-F.col(c)).alias(c) for c in sums]))).alias("x")).select("part", "step", "x.*")
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails_{i}") for i in range(n)],
        *[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"unique_{i}") for i in range(n)])
    last = factorial(n)
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("rank"),
        *[F.lit(0).cast("long").alias(c) for c in sums])
    steps = ends.filter(F.col("rank") < last).union(grid).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in sums])
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    removed = steps.select("part", "step", "rank", *[F.sum(c).over(running).alias(c) for c in sums])
    named = removed.join(F.broadcast(_orders(spark, filters)), ["rank", "step"]).join(parts, "part")
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {kind: F.get(F.array(*[f"{kind}_{i}" for i in range(n)]), F.col("filter")) for kind in ("fails", "unique")}
    return named.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (own["fails"] - F.col("n")).alias("redundant"), own["unique"].alias("unique_fails"), F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"))
