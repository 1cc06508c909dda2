"""The corpus pipeline: stages over ``documents``, each kept as a table.

SQL cannot express the first stage (a learned model), so there is no statement for
the whole; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontaminate, langid, lines, minhash, packing
from textmill.llm.substrings import row_key
from textmill.llm.tables import read, stored
from textmill.llm.words import held_out

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document goes if its words do not agree on a language by this much.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay: some letter, and words that agree well enough.

    The tagger learns from the labels of two thirds of the rows; without any label
    there is nothing to judge by, and only texts without a letter go.
    """
    tagger = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "text", "lang"))
    if tagger is None:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return langid.identify(docs, tagger).filter(
        (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one; n_chars follows the text."""
    left = lines.LineIndex.build(docs).apply(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return left.select(*[
        F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed
        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of
    rows that are equal in id and text, one.  Rows without a word are no duplicates."""
    rows = docs.select("*", *row_key(F.col("doc_id"), F.col("text")))
    groups = stored(minhash.grouped(rows, carry=("k0", "k1")), "groups")
    name = F.coalesce(F.col("component").cast("string"), F.hex("digest"))
    first = F.min(F.struct(F.col("node").isNull().alias("no_id"), "node", "k0", "k1"))
    keep = groups.filter("digest is not null").groupBy(name.alias("name")).agg(first.alias("first")).select("first.k0", "first.k1")
    without_words = groups.filter("digest is null").select("k0", "k1").distinct()
    one_each = rows.join(keep, ["k0", "k1"], "left_semi").dropDuplicates(["k0", "k1"])
    return one_each.union(rows.join(without_words, ["k0", "k1"], "left_semi")).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate stay.  The verdict is one on the
    text, so it is joined by the text, whatever the ids are."""
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(name.alias("doc_id"), "text")
    bad = decontaminate.find_contamination(texts, read(spark, sf_dir, "benchmark")).filter("contaminated").select(
        F.col("doc_id").alias("bad_text")).distinct()
    return docs.join(bad, name == bad["bad_text"], "left_anti")


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.pack_documents(docs, packing.token_count(F.col("text")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
