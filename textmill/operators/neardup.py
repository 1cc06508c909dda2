"""Near duplicates: all pairs of texts whose 3-gram sets have Jaccard >= t.

By default blocks of sets of similar size are compared (:mod:`textmill.operators.setblocks`).
With a radius, signatures find the pairs, exact and without comparing all.  Two sets x, y with Jaccard >= t differ in
at most h = (1-t)/(1+t) * (|x|+|y|) grams.  The grams are hashed into parts, so
few that some parts hold at most ``radius`` of the differing grams.  Within a
part every gram gets a random vector of radius + 1 bits, and each nonzero vector
v gives a signature of the grams whose vectors are odd with v.  The vectors of
at most ``radius`` differing grams leave some v that is even with all of them, so
one signature agrees for sure (covering locality-sensitive hashing, from the
published literature).  Equal signatures meet in an equi-join, pairs that meet
in too few parts are dropped, and the rest are verified on the full sets.

Why not an inverted index on single grams: there are only some ten thousand
3-grams, so its lists grow with the table and the candidates with its square.
A signature holds half the grams of a part, and a part more grams the larger
the radius is; sets that agree on all of these are mostly similar.  Before the
sets themselves are fetched, a parity sketch (2048
bits per set) bounds the difference of a pair from below: a bit that differs
needs a differing gram.  Pairs beyond the allowed difference are dropped, which
no true match can be.

Rows with identical sets collapse to one representative before any join, so a
text that fills a third of the table is one set here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.text import jaccard, text_shingles
from textmill.operators import setblocks
from textmill.session import materialize

_SLACK = 2  # parts beyond the first that two partners must agree on
_RADIUS = 2  # differing grams that a part may hold and still agree


def gram_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set_key, grams): the key is equal exactly when the sets are.

    Normalised text holds no control whitespace, so \\x1f separates safely.
    """
    # Never null, so that joins on the key do not compute it again to check.
    sorted_grams = F.sort_array(text_shingles(F.coalesce(F.col(text_col), F.lit(""))))
    return (
        df.select(F.col(id_col).alias("id"), sorted_grams.alias("grams"))
        .withColumn("set_key", F.md5(F.array_join("grams", "\x1f")))
        .withColumn("grams", F.transform("grams", _packed))
        .select("id", "set_key", "grams")
    )


def _packed(gram: Column) -> Column:
    """Up to three code points in one long, so that sets compare as numbers."""
    first, second, third = (F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3))
    return F.shiftleft(first, 42) + F.shiftleft(second, 21) + third


def distinct_sets(sets: DataFrame) -> DataFrame:
    """One row per distinct set: (set_key, id of its first row, grams, size)."""
    w = Window.partitionBy("set_key").orderBy("id")
    return (
        sets.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select("set_key", "id", "grams", F.size("grams").alias("size"))
    )


def _size_step(threshold: float) -> float:
    # A hair above 1/t, so that rounding never puts partners two steps apart.
    return math.log(1.0 / threshold) + 1e-9


def _spread(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a public finaliser for random numbers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _differing(level: int, threshold: float) -> int:
    """Most grams that partners at a level differ in; it serves sizes below e^(step*(level+2))."""
    return math.floor(2 * (1 - threshold) / (1 + threshold) * math.exp(_size_step(threshold) * (level + 2)) + 1e-6)


def covering(grams: np.ndarray, level: int, differing: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set (64-bit numbers), and the part of each."""
    radius = min(radius, differing)
    parts, vectors = differing // (radius + 1) + 1 + _SLACK, 1 << (radius + 1)
    h = _spread(grams.astype(np.uint64))
    part = (_spread(h + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    vector = (_spread(h + np.uint64(2)) & np.uint64(vectors - 1)).astype(np.int64)
    sums = np.zeros(parts * vectors, np.uint64)
    np.add.at(sums, part * vectors + vector, h)
    sums = sums.reshape(parts, vectors)
    even = sums
    for bit in range(radius + 1):  # for every v at once: the sums of even vectors less those of odd ones
        even = even.reshape(parts, -1, 2, 1 << bit)
        even = np.stack([even[:, :, 0] + even[:, :, 1], even[:, :, 0] - even[:, :, 1]], axis=2)
    odd = sums.sum(axis=1, keepdims=True) - even.reshape(parts, vectors)
    name = np.arange(parts * vectors, dtype=np.uint64).reshape(parts, vectors) + (np.uint64(level + (1 << 20)) << np.uint64(32))
    return _spread(odd ^ _spread(name))[:, 1:].ravel(), np.repeat(np.arange(parts, dtype=np.int32), vectors - 1)


def _signing(threshold: float, radius: int):
    """Arrow task: (id, grams) to the signatures of each set at its levels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, upper, part, key = [], [], [], []
                for i, grams in enumerate(b.column(1)):
                    grams = grams.values.to_numpy()
                    step = math.floor(math.log(len(grams)) / _size_step(threshold))
                    for above in (0, 1):
                        most = _differing(step - above, threshold)
                        if most > 0:  # partners that differ in nothing are equal sets
                            keys, parts = covering(grams, step - above, most, radius)
                            row.append(np.full(len(keys), i))
                            upper.append(np.full(len(keys), above))
                            part.append(parts)
                            key.append(keys)
                if row:
                    row = np.concatenate(row)
                    size = np.diff(b.column(1).offsets.to_numpy())
                    yield pa.record_batch(
                        [b.column(0).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(np.concatenate(upper).astype(bool)),
                         pa.array(np.concatenate(part)), pa.array(np.concatenate(key).view(np.int64))], ["id", "size", "upper", "part", "key"])

    return run


def signatures(distinct: DataFrame, threshold: float, radius: int = _RADIUS) -> DataFrame:
    """(id, size, upper, part, key), one row per signature; the key names level, part and vector as well.

    Sizes fall into geometric steps.  Partners lie in the same or in adjacent
    steps, so a set enters the level of its own step, and as the ``upper``
    partner the level below.  A larger radius gives more signatures and fewer
    candidates.
    """
    kind = distinct.schema["id"].dataType.simpleString()
    return distinct.filter("size > 0").select("id", "grams").mapInArrow(
        _signing(threshold, radius), f"id {kind}, size int, upper boolean, part int, key long")


_SKETCH_WORDS = 32


def sketches(distinct: DataFrame) -> DataFrame:
    """(id, size, sketch): the parity of the grams in each of 2048 classes.

    Keeps the distribution by ``set_key``: no shuffle.
    """
    slot = F.pmod(F.xxhash64(F.lit("sketch"), "gram"), F.lit(64 * _SKETCH_WORDS))
    per_set = ["set_key", "id", "size"]
    words = (
        distinct.select(*per_set, F.explode("grams").alias("gram"))
        .withColumn("slot", slot.cast("int"))
        .groupBy(*per_set, F.pmod("slot", F.lit(_SKETCH_WORDS)).alias("word"))
        .agg(F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"),
                                       F.expr(f"slot div {_SKETCH_WORDS}").cast("int"))).alias("bits"))
    )
    by_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    return (
        words.groupBy(*per_set)
        .agg(by_word.alias("bits"))
        .select(
            "id",
            "size",
            F.transform(
                F.sequence(F.lit(0), F.lit(_SKETCH_WORDS - 1)),
                lambda w: F.coalesce(F.try_element_at("bits", w), F.lit(0).cast("long")),
            ).alias("sketch"),
        )
    )


def _may_match(a: str, b: str, threshold: float) -> Column:
    differing = F.aggregate(
        F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda acc, n: acc + n,
    )
    allowed = (1 - threshold) / (1 + threshold) * (F.col(f"{a}.size") + F.col(f"{b}.size"))
    return differing <= allowed + 1e-6


def candidate_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left_id < right_id) that agree in enough parts to be partners."""
    a, b = sigs.alias("a"), sigs.alias("b")
    low = F.least("a.size", "b.size")
    high = F.greatest("a.size", "b.size")
    met = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.id") < F.col("b.id"))
        & (low >= threshold * high - 1e-9)
        & ~(F.col("a.upper") & F.col("b.upper")),
    )
    return (
        met.groupBy(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
        .agg(F.size(F.collect_set("a.part")).alias("parts"))
        .filter(F.col("parts") >= 1 + _SLACK)
        .select("left_id", "right_id")
    )


def _signed_pairs(sets: DataFrame, threshold: float, radius: int) -> DataFrame:
    """Pairs of different sets that meet in signatures, verified."""
    distinct = distinct_sets(sets)
    pairs = candidate_pairs(signatures(distinct, threshold, radius), threshold)
    outline = sketches(distinct)
    pairs = (
        pairs.join(outline.alias("a"), F.col("left_id") == F.col("a.id"))
        .join(outline.alias("b"), F.col("right_id") == F.col("b.id"))
        .filter(_may_match("a", "b", threshold))
        .select("left_id", "right_id")
    )
    left = distinct.select(F.col("id").alias("left_id"), F.col("grams").alias("left_grams"))
    right = distinct.select(F.col("id").alias("right_id"), F.col("grams").alias("right_grams"))
    return (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .select(
            "left_id",
            "right_id",
            jaccard(F.col("left_grams"), F.col("right_grams")).alias("similarity"),
        )
        .filter(F.col("similarity") >= threshold)
    )


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, radius: int | None = None
) -> DataFrame:
    """(left_id, right_id, similarity).

    Every pair of distinct gram sets at or above the threshold is listed once,
    between the first rows of the two sets.  Further rows of a set are linked to
    its first row with similarity 1, so the result grows with the rows and the
    near pairs, not with the square of the copies.

    Blocks of sets are compared (:mod:`textmill.operators.setblocks`), or, with a ``radius``,
    sets that share signatures.  On texts of one language most pairs share some, and the
    candidates then fill the disk.

    The gram sets are written to the shared folder when this is called, so the texts are
    cut once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if radius is None:
        texts = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
        kind = texts.schema["id"].dataType.simpleString()
        packed = texts.mapInArrow(setblocks.cutting, f"id {kind}, set_key string, size int, packed binary")
        sets = materialize(packed, "grams")
        verified = setblocks.close_pairs(setblocks.first_sets(sets), threshold)
    else:
        sets = materialize(gram_sets(df, id_col, text_col), "grams")
        verified = _signed_pairs(sets, threshold, radius)
    keys = sets.select("set_key", F.col("id").alias("right_id"))
    firsts = (
        keys.groupBy("set_key")
        .agg(F.min("right_id").alias("left_id"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    copies = (
        keys.join(firsts, "set_key")
        .filter("right_id > left_id")
        .select("left_id", "right_id", F.lit(1.0).alias("similarity"))
    )
    return verified.unionByName(copies)
