"""TF-IDF features from word and character n-grams.

``TextFeatures.fit`` counts terms with one shuffle per block (map-side combined,
keyed by term) and keeps the most frequent ones.  ``TextFeatureModel.transform``
works row by row on the executors: no join and no shuffle.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.exprs import col, let
from textmill.functions.text import char_ngrams
from textmill.models import blocks, grams

WORD, CHAR = "word", "char"

_VECTOR_JSON = T.StructType(
    [
        T.StructField("type", T.ByteType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


@cache
def _accents() -> tuple[str, str]:
    """Characters that are one letter with marks and these letters, then the marks alone."""
    parted, letters = [], []
    for c in map(chr, range(0x80, 0x3000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            parted.append(c)
            letters.append(plain)
    return "".join(parted + [chr(c) for c in range(0x300, 0x370)]), "".join(letters)


def strip_accents(text: Column | str) -> Column:
    """Letters without their accents; texts of ASCII alone pass untouched."""
    c = col(text)
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(c, *_accents()))


def word_terms(text: Column | str, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """Word n-grams of the text in lower case without accents, repeated as often as they occur."""

    def grams(tokens: Column) -> Column:
        blocks = []
        for n in range(ngram_range[0], ngram_range[1] + 1):
            if n == 1:
                blocks.append(tokens)
            elif n == 2:
                blocks.append(
                    F.zip_with(
                        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
                        F.slice(tokens, 2, F.size(tokens)),
                        lambda a, b: F.concat_ws(" ", a, b),
                    )
                )
            else:
                starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
                run = _runs(tokens, starts, n)
                none = F.array().cast("array<string>")
                blocks.append(F.when(F.size(tokens) >= n, run).otherwise(none))
        return F.concat(*blocks)

    return let(_words(text), grams)


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(strip_accents(F.lower(col(text))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def _plain(text: Column | str) -> Column:
    return F.regexp_replace(strip_accents(F.lower(col(text))), r"\s\s+", " ")


def char_terms(text: Column | str, ngram_range: tuple[int, int] = (2, 5)) -> Column:
    """Character n-grams across blanks, in lower case without accents, repeated as often as they occur."""
    lo, hi = ngram_range
    return let(_plain(text), lambda t: F.concat(*[char_ngrams(t, n) for n in range(lo, hi + 1)]))


def _block_text(name: str, text: Column | str) -> Column:
    """The text whose words between blanks, or whose characters, are the parts of a block's terms."""
    return F.coalesce(F.array_join(_words(text), " ") if name == WORD else _plain(text), F.lit(""))


_KINDS = {WORD: grams.Words, CHAR: grams.Characters}


def term_counts(df: DataFrame, name: str, text: Column | str, ngram_range: tuple[int, int]) -> DataFrame:
    """(term, df, tf) over the corpus: the terms of :func:`word_terms` or :func:`char_terms`.

    Tasks count their rows slice by slice; their counts are summed by term, so neither
    row ids nor single occurrences are shuffled.
    """
    texts = df.select(_block_text(name, text).alias("text"))
    counts = texts.mapInArrow(grams.counting(_KINDS[name], tuple(ngram_range)), grams.COUNTS)
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def select_terms(
    counts: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int
) -> DataFrame:
    """The most frequent terms within the document-frequency limits.

    Equal counts are decided by the term.
    """
    return (
        counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )


def inverse_df(df: int, n_docs: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1


@dataclass(frozen=True)
class Block:
    """Terms in the order of their index, with document frequency and idf."""

    name: str
    terms: tuple[str, ...]
    dfs: tuple[int, ...]
    idfs: tuple[float, ...]


class TextFeatures(Estimator):
    """Learns the vocabulary, the idf weights and the label dictionary."""

    def __init__(
        self,
        text_col: str = "text",
        label_col: str = "label",
        max_features: int = 5000,
        min_df: int = 2,
        max_df: float = 0.95,
        ngram_range: tuple[int, int] = (1, 2),
        use_char_ngrams: bool = True,
        char_ngram_range: tuple[int, int] = (2, 5),
        char_max_features: int = 3000,
        sublinear_tf: bool = True,
    ):
        super().__init__()
        self.text_col = text_col
        self.label_col = label_col
        self.max_features = max_features
        self.min_df = min_df
        self.max_df = max_df
        self.ngram_range = tuple(ngram_range)
        self.use_char_ngrams = use_char_ngrams
        self.char_ngram_range = tuple(char_ngram_range)
        self.char_max_features = char_max_features
        self.sublinear_tf = sublinear_tf

    def blocks(self) -> dict[str, tuple[tuple[int, int], float, int]]:
        """Block -> (ngram_range, max_df, max_features).  Characters have no max_df."""
        blocks = {WORD: (self.ngram_range, self.max_df, self.max_features)}
        if self.use_char_ngrams:
            blocks[CHAR] = (self.char_ngram_range, 1.0, self.char_max_features)
        return blocks

    def _fit(self, dataset: DataFrame) -> TextFeatureModel:
        n_docs = dataset.count()
        blocks = []
        for name, (ngram_range, max_df, limit) in self.blocks().items():
            counts = term_counts(dataset, name, self.text_col, ngram_range)
            chosen = select_terms(counts, n_docs, self.min_df, max_df, limit)
            # At most max_features rows reach the driver.
            rows = sorted((r["term"], r["df"]) for r in chosen.select("term", "df").collect())
            if not rows:
                raise ValueError(f"no {name} term is left; lower min_df or raise max_df")
            blocks.append(
                Block(
                    name,
                    tuple(t for t, _ in rows),
                    tuple(d for _, d in rows),
                    tuple(inverse_df(d, n_docs) for _, d in rows),
                )
            )
        return TextFeatureModel(self.settings(), tuple(blocks), self._labels(dataset))

    def fit_labels(self, dataset: DataFrame) -> TextFeatureModel:
        """The label dictionary alone: no text is read."""
        return TextFeatureModel(self.settings(), (), self._labels(dataset))

    def _labels(self, dataset: DataFrame) -> tuple[str, ...]:
        if self.label_col not in dataset.columns:
            return ()
        return tuple(r[0] for r in dataset.select(self.label_col).distinct().orderBy(self.label_col).collect())

    def settings(self) -> dict:
        return {
            "text_col": self.text_col,
            "label_col": self.label_col,
            "ngram_range": list(self.ngram_range),
            "char_ngram_range": list(self.char_ngram_range),
            "sublinear_tf": self.sublinear_tf,
        }


class TextFeatureModel(Model):
    """Adds ``indices`` and ``values`` (a sparse row), and ``label_idx`` if the
    label column is there."""

    def __init__(self, settings: dict, blocks: tuple[Block, ...], labels: tuple[str, ...]):
        super().__init__()
        self.settings = settings
        self.blocks = blocks
        self.labels = labels

    # -- dictionary ---------------------------------------------------------

    @property
    def vocabulary_size(self) -> int:
        return sum(len(b.terms) for b in self.blocks)

    @property
    def num_classes(self) -> int:
        return len(self.labels)

    def feature_names(self) -> list[str]:
        return [f"char_{t}" if b.name == CHAR else t for b in self.blocks for t in b.terms]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(term_idx, block, term, df, idf)"""
        rows, offset = [], 0
        for b in self.blocks:
            rows += [
                (offset + i, b.name, t, b.dfs[i], b.idfs[i]) for i, t in enumerate(b.terms)
            ]
            offset += len(b.terms)
        return spark.createDataFrame(
            rows, "term_idx int, block string, term string, df long, idf double"
        )

    def label_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(enumerate(self.labels)), "label_idx int, label string"
        )

    def encode_label(self, label: Column | str) -> Column:
        return (F.array_position(_constant(self.labels, "array<string>"), col(label)) - 1).cast("int")

    def decode_label(self, label_idx: Column | str) -> Column:
        return F.try_element_at(
            _constant(self.labels, "array<string>"), (col(label_idx) + 1).cast("int")
        )

    # -- transform ----------------------------------------------------------

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text, ranges = self.settings["text_col"], {WORD: "ngram_range", CHAR: "char_ngram_range"}
        known = [grams.Vocabulary(_KINDS[b.name], b.terms, tuple(self.settings[ranges[b.name]])) for b in self.blocks]
        weigh = grams.weighing(known, [np.array(b.idfs) for b in self.blocks], self.settings["sublinear_tf"])

        @F.arrow_udf("struct<indices: array<int>, values: array<double>>")
        def row(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            # The slices of a batch leave one by one: weights take several times the room of their texts.
            for texts in batches:
                for part in grams.pieces(*([texts] if isinstance(texts, pa.Array) else texts)):
                    yield weigh(*part)

        out = dataset.withColumn("_row", row(*[_block_text(b.name, text) for b in self.blocks]))
        out = out.withColumn("indices", F.col("_row.indices")).withColumn("values", F.col("_row.values"))
        keep = [*dataset.columns, "indices", "values"]
        label = self.settings["label_col"]
        if self.labels and label in dataset.columns:
            out = out.withColumn("label_idx", self.encode_label(label))
            keep.append("label_idx")
        return out.select(*keep)

    def packed(self, dataset: DataFrame, marks: Sequence[str]) -> DataFrame:
        """The features, labels and ``marks`` of :meth:`transform` as blocks of rows for the solver: a cell
        holds its count, from which its weight is computed again, so it takes a quarter of the room."""
        text, ranges = self.settings["text_col"], {WORD: "ngram_range", CHAR: "char_ngram_range"}
        known = [grams.Vocabulary(_KINDS[b.name], b.terms, tuple(self.settings[ranges[b.name]])) for b in self.blocks]
        idfs = [np.array(b.idfs) for b in self.blocks]
        sublinear, n = self.settings["sublinear_tf"], len(self.blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = blocks.Packer(marks, np.concatenate(idfs), grams.parts_of(known, idfs), sublinear)
            for batch in batches:
                for piece in grams.pieces(*batch.columns[:n], others=batch.columns[n:]):
                    rest = [c.to_numpy(zero_copy_only=False) for c in piece[n:]]
                    yield from packer.add(*grams.counted(known, idfs, piece[:n]), rest[0], rest[1:])
            yield from packer.rest()

        label = self.encode_label(self.settings["label_col"])
        source = dataset.select(*[_block_text(b.name, text).alias(f"_{i}") for i, b in enumerate(self.blocks)],
                                label.alias("label_idx"), *marks)
        return source.mapInArrow(run, blocks.schema(marks))

    # -- persistence --------------------------------------------------------

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.label_table(spark).write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame([(json.dumps(self.settings),)], "settings string").write.mode(
            "overwrite"
        ).parquet(f"{path}/features")

    @classmethod
    def load(cls, path: str) -> TextFeatureModel:
        spark = SparkSession.active()
        settings = json.loads(spark.read.parquet(f"{path}/features").first()[0])
        rows = spark.read.parquet(f"{path}/vocabulary").orderBy("term_idx").collect()
        blocks = []
        for name in (WORD, CHAR):
            own = [r for r in rows if r["block"] == name]
            if own:
                blocks.append(
                    Block(
                        name,
                        tuple(r["term"] for r in own),
                        tuple(r["df"] for r in own),
                        tuple(r["idf"] for r in own),
                    )
                )
        labels = spark.read.parquet(f"{path}/labels").orderBy("label_idx").collect()
        return cls(settings, tuple(blocks), tuple(r["label"] for r in labels))


def _runs(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def _constant(values: Sequence, kind: str) -> Column:
    """A constant array as one literal: folded before execution, so a long list
    does not become a long expression."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def unpack_vector(vector: Column | str) -> Column:
    """Sparse ML vector -> struct (type, size, indices, values): the same bytes, seen as a struct."""
    return F.unwrap_udt(col(vector))


def pack_vector(indices: Column | str, values: Column | str, size: int) -> Column:
    """Arrays -> sparse ML vector, inside the JVM."""
    schema = T.StructType([T.StructField("v", VectorUDT())])
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        col(indices).alias("indices"),
        col(values).alias("values"),
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]


def long_form(features: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """(id, columns, term_idx, weight), one row per non-zero weight."""
    kept = [F.col(c) for c in (id_col, *columns)]
    return features.select(
        *kept, F.inline(F.arrays_zip("indices", "values"))
    ).select(*kept, F.col("indices").alias("term_idx"), F.col("values").alias("weight"))


def matrix_profile(features: DataFrame, model: TextFeatureModel) -> DataFrame:
    """One row: shape, non-zeros, sparsity in percent, classes."""
    cells = F.count("*") * F.lit(model.vocabulary_size)
    nnz = F.coalesce(F.sum(F.size("indices").cast("long")), F.lit(0).cast("long"))
    return features.agg(
        F.count("*").alias("n_rows"),
        F.lit(model.vocabulary_size).cast("long").alias("n_terms"),
        F.lit(model.num_classes).cast("long").alias("n_labels"),
        nnz.alias("n_nonzero"),
        (100.0 * (1 - F.try_divide(nnz.cast("double"), cells.cast("double")))).alias("sparsity"),
    )
