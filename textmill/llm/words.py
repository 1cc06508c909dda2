"""Splitting texts into words: column expressions, and numpy for Arrow batches.

The numpy functions work on the bytes of a whole slice of texts at once, so no
Python object is made for a word.  A word is known by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words, as bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_WHITE = "\t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def space_words(text: Column) -> Column:
    """The words between white space; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _WHITE, " " * len(_WHITE)), " "), "")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, falls into the fold; a row without id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# -- Arrow batches ------------------------------------------------------------

def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts take some ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        size = np.diff(offsets(batch.column(at).fill_null("")))
        piece = (np.cumsum(size) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text begins and the last ends."""
    texts = texts.fill_null("")
    at, data = offsets(texts), texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] else np.zeros(0, np.uint8)
    return whole, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~gaps[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a public finaliser for random numbers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    n = end - start
    h = mix((n.astype(np.uint64) << np.uint64(40)) ^ (eight[start] & _MASK[np.minimum(n, 8)]))
    more, done = np.flatnonzero(n > 8), 8
    while len(more) and done < 64:
        h[more] = mix(h[more] * np.uint64(3) ^ (eight[start[more] + done] & _MASK[np.minimum(n[more] - done, 8)]))
        done += 8
        more = more[n[more] > done]
    for i in more:  # words of more than 64 bytes are rare, and may be very long
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(texts: pa.Array, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z in lower case, and for each text the number of words before it."""
    raw, at = text_bytes(texts)
    raw = _LOWER[raw]
    start, end, before = word_spans(raw, at, gaps)
    return hash_spans(raw, start, end), before


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
