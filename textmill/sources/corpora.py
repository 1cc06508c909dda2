"""Labelled corpora in CSV files and in pairs of text and label files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.config import DatasetConfig
from textmill.fixed_values import CSV_NULLS
from textmill.functions.labels import normalize_label
from textmill.functions.text import clean_html
from textmill.operators.clean import clean_corpus, clean_frame, require_columns
from textmill.operators.dedup import drop_exact_duplicates
from textmill.sources import quoted

ORDER = ("source_rank", "row_id")


def require_path(spark: SparkSession, path: str, what: str = "Dataset") -> str:
    """The path, or FileNotFoundError; works for every Hadoop file system."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, id_col: str | None = None, whole_files: bool = False) -> DataFrame:
    """All columns as strings, missing markers as null, and a ``row_id``.

    Quoted fields may span lines; files are read in many tasks nevertheless
    (:mod:`textmill.sources.quoted`).  Files with stray quotes inside of unquoted
    fields need ``whole_files``, which makes a file one task.  ``row_id`` numbers the
    rows by the path of their file and their position, however Spark packs the files
    into tasks.  A stored id (``id_col``) is used instead where there is one.
    """
    require_path(spark, path)
    columns = csv_header(spark, path)
    rows = _whole_files(spark, path, columns) if whole_files else quoted.parsed(quoted.csv_records(spark, path), columns)
    known = rows.select(
        "file", "record", *[F.when(~F.col(f"`{c}`").isin(*CSV_NULLS), F.col(f"`{c}`")).alias(c) for c in columns]
    )
    if id_col:
        return known.drop("file", "record").withColumn("row_id", F.col(id_col).cast("long"))
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    if len(files) == 1:
        return known.select(*columns, (F.col("record") - 1).alias("row_id"))
    ranks = spark.createDataFrame([(re.sub(":/+", ":/", f), k) for k, f in enumerate(files)], "_file string, _rank long")
    return (
        known.withColumn("_file", F.regexp_replace("file", ":/+", ":/")).join(F.broadcast(ranks), "_file", "left")
        .select(*columns, (F.shiftleft("_rank", 33) + F.col("record") - 1).alias("row_id"))
    )


def _whole_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    # The lower 33 bits number the rows of a task, which reads file after file.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.col("_metadata.file_path").alias("file"), (place + 1).alias("record"), *columns)


def list_csv_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length) of the CSV files in a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .load(require_path(spark, directory, "Directory"))
        .select("path", "length")
    )


def read_csv_directory(spark: SparkSession, directory: str) -> DataFrame:
    """All CSV files of a folder with the name of their file."""
    require_path(spark, directory, "Directory")
    columns = spark.read.options(header=True, pathGlobFilter="*.csv").csv(directory).columns
    rows = quoted.parsed(quoted.csv_records(spark, directory, "*.csv"), columns)
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.element_at(F.split("file", "/"), -1).alias("source_file"))


def canonical(
    df: DataFrame, text: Column | str, label: Column | str, source_rank: int, row_id: Column | str = "row_id"
) -> DataFrame:
    """(row_id, source_rank, text, label)"""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_col(row_id).alias("row_id"),
        F.lit(source_rank).alias("source_rank"),
        as_col(text).alias("text"),
        as_col(label).alias("label"),
    )


def load_first(spark: SparkSession, path: str | None = None, config: DatasetConfig = DatasetConfig(),
               id_col: str | None = None) -> DataFrame:
    """First CSV: text and label columns out of several, cleaned."""
    df = read_csv(spark, path or config.resume_csv, id_col)
    require_columns(df, [config.resume_text_column, config.category_column], "first dataset")
    out = canonical(df, config.resume_text_column, config.category_column, 0)
    return clean_frame(out, "text", ORDER, config.remove_duplicates, config.drop_na)


def load_second(spark: SparkSession, path: str | None = None, config: DatasetConfig = DatasetConfig(),
                id_col: str | None = None) -> DataFrame:
    """Second CSV: a null in any of its columns drops the row, then text and label."""
    df = read_csv(spark, path or config.updated_csv, id_col)
    require_columns(df, ["Resume", "Category"], "second dataset")
    cleaned = clean_frame(df, "Resume", ["row_id"], config.remove_duplicates, config.drop_na)
    return canonical(cleaned, "Resume", "Category", 1)


def load_third(spark: SparkSession, path: str | None = None, config: DatasetConfig = DatasetConfig(),
               id_col: str | None = None) -> DataFrame:
    """Third CSV: label and text columns are required."""
    where = path or config.corpus_csv
    if not path_exists(spark, where):
        raise FileNotFoundError(
            f"{where} not found. Build it from its text and label files first (ingest_pairs)."
        )
    df = read_csv(spark, where, id_col)
    require_columns(df, ["Category", "Resume"], "third dataset")
    out = canonical(df, "Resume", "Category", 2)
    return clean_frame(out, "text", ORDER, config.remove_duplicates, config.drop_na)


def combine(sources: Sequence[DataFrame], remove_duplicates: bool = True) -> DataFrame:
    """Union of canonical corpora; the first source, then the first row, wins."""
    if not sources:
        raise ValueError("No datasets found to load")
    together = reduce(lambda a, b: a.unionByName(b), sources)
    return drop_exact_duplicates(together, "text", ORDER) if remove_duplicates else together


def combine_statistics(sources: Sequence[DataFrame]) -> DataFrame:
    """One row: combined rows, duplicates across sources, rows and labels left."""
    together = reduce(lambda a, b: a.unionByName(b), sources)
    zero = F.lit(0).cast("long")
    before = together.agg(F.count("*").alias("n_combined"), zero.alias("n_final"), zero.alias("n_labels"))
    after = combine(sources).agg(
        zero.alias("n_combined"), F.count("*").alias("n_final"),
        F.count_distinct("label").alias("n_labels"),
    )
    total = before.unionByName(after).agg(
        *[F.sum(c).alias(c) for c in ("n_combined", "n_final", "n_labels")]
    )
    return total.select(
        "n_combined", (F.col("n_combined") - F.col("n_final")).alias("n_cross_duplicates"),
        "n_final", "n_labels",
    )


def load_combined(
    spark: SparkSession, include_first: bool = True, include_second: bool = True,
    include_third: bool = False, config: DatasetConfig = DatasetConfig(),
) -> DataFrame:
    """The CSV corpora that are there, combined; an error if none is."""
    wanted = [
        (include_first, config.resume_csv, load_first),
        (include_second, config.updated_csv, load_second),
        (include_third, config.corpus_csv, load_third),
    ]
    found = [load(spark, path, config) for use, path, load in wanted
             if use and path_exists(spark, path)]
    return combine(found, config.remove_duplicates)


def clean_combined(corpus: DataFrame, **options) -> DataFrame:
    """Cleaned corpus whose label is the normalised one."""
    kept = clean_corpus(corpus, "row_id", "text", "label", ORDER, **options).kept
    return kept.withColumn("label", F.col("normalized_label")).drop("normalized_label")


MODES = ("clean", "resume", "updated", "corpus", "both", "all")


def load_dataset(spark: SparkSession, mode: str = "clean", config: DatasetConfig = DatasetConfig()) -> DataFrame:
    """The named combination of CSV corpora."""
    loaders = {
        "clean": lambda: clean_combined(load_combined(spark, include_third=True, config=config)),
        "resume": lambda: load_first(spark, config=config),
        "updated": lambda: load_second(spark, config=config),
        "corpus": lambda: load_third(spark, config=config),
        "both": lambda: load_combined(spark, config=config),
        "all": lambda: load_combined(spark, include_third=True, config=config),
    }
    if mode not in loaders:
        raise ValueError(f"Invalid dataset mode: {mode}. Use one of {', '.join(MODES)}")
    return loaders[mode]()


def select_sources(mode: str, sources: Mapping[str, DataFrame]) -> DataFrame:
    """The same combinations over tables: ``first``, ``second`` and ``third``."""
    parts = {
        "resume": ["first"], "updated": ["second"], "corpus": ["third"],
        "both": ["first", "second"], "all": ["first", "second", "third"],
        "clean": ["first", "second", "third"],
    }
    if mode not in parts:
        raise ValueError(f"Invalid dataset mode: {mode}. Use one of {', '.join(MODES)}")
    corpus = combine([sources[p] for p in parts[mode]])
    return clean_combined(corpus) if mode == "clean" else corpus


def pair_texts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, content) of text files and of label files -> (stem, text, label).

    Tags are stripped, the first line of the label file is the label, normalised.
    The first stem wins among equal texts.
    """
    first_line = F.split_part(F.col("lab"), F.lit("\n"), F.lit(1))
    rows = texts.select("stem", F.col("content").alias("txt")).join(
        labels.select("stem", F.col("content").alias("lab")), "stem"
    )
    return drop_exact_duplicates(
        rows.select("stem", clean_html("txt").alias("text"), normalize_label(first_line).alias("label")),
        "text", ["stem"],
    )


def ingest_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """A folder of ``name.txt`` and ``name.lab`` files -> (stem, text, label)."""
    require_path(spark, directory, "Directory")

    def files(ending: str) -> DataFrame:
        raw = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{ending}").text(directory)
        name = F.col("_metadata.file_name")
        stem = F.left(name, F.length(name) - len(ending))
        return raw.select(stem.alias("stem"), F.col("value").alias("content"))

    return pair_texts(files(".txt"), files(".lab"))
