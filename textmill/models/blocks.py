"""Blocks of feature rows as bytes, a row of a table each.

A block names the features that its rows have, so that its products take no others, and its
cells point into these names.  A cell holds a weight, or the count from which :mod:`textmill.models.grams`
computes it again; counts and pointers take as few bytes as they need.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.models import grams
from textmill.models.sparse import SparseRows

ROWS = 512  # rows in a block, at most
CELLS = 1 << 20  # cells of the rows in a block, if it is more than one
COLUMNS = ("packed_names", "packed_indices", "packed_values", "packed_at", "packed_labels", "packed_idf", "packed_part")


def schema(marks: Sequence[str]) -> str:
    return ", ".join(f"`{c}` binary" for c in (*COLUMNS, *marks))


def are_packed(df: DataFrame) -> bool:
    return COLUMNS[0] in df.columns


def _least(numbers: np.ndarray) -> np.ndarray:
    """In the fewest bytes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())) if len(numbers) else np.uint8)


def _numbers(column: pa.Scalar, n: int) -> np.ndarray:
    """n numbers of as many bytes as there are."""
    data = column.as_buffer()
    return np.frombuffer(data, f"u{data.size // n}" if n else np.uint8)


def pack(x: SparseRows, labels: np.ndarray, marks: Sequence[np.ndarray], names: Sequence[str],
         idf: np.ndarray | None = None, part: np.ndarray | None = None, sublinear: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows to blocks; with ``idf`` and ``part`` of every feature the values are counts."""
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(x.at, x.at[lo] + CELLS, "right")) - 1)
        hi = min(hi, lo + ROWS, len(x))
        index, value = x.indices[x.at[lo]:x.at[hi]], x.values[x.at[lo]:x.at[hi]]
        there = np.zeros(int(index.max()) + 1 if len(index) else 1, bool)
        there[index] = True
        known = np.flatnonzero(there)
        parts = [known.astype(np.int32), _least((np.cumsum(there) - 1)[index]), value.astype(np.float64) if idf is None else _least(value),
                 x.at[lo:hi + 1] - x.at[lo], labels[lo:hi].astype(np.int32)]
        data = [p.tobytes() for p in parts]
        data += [b"", b""] if idf is None else [
            idf[known].astype(np.float64).tobytes(), struct.pack("<BB", sublinear, part.max() + 1) + part[known].astype(np.uint8).tobytes()]
        data += [m[lo:hi].astype(np.float64).tobytes() for m in marks]
        yield pa.record_batch([pa.array([d], pa.binary()) for d in data], [*COLUMNS, *names])
        lo = hi


class Packer:
    """Gathers the counts of slices of rows until they fill a block."""

    def __init__(self, marks: Sequence[str], idf: np.ndarray, part: np.ndarray, sublinear: bool):
        self.marks, self.known = marks, (idf, part, sublinear)
        self.held: list[tuple] = []

    def add(self, sizes, index, tf, labels, marks) -> Iterator[pa.RecordBatch]:
        self.held.append((sizes, index, tf, labels, *marks))
        if sum(len(h[0]) for h in self.held) >= ROWS or sum(len(h[1]) for h in self.held) >= CELLS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            sizes, index, tf, labels, *marks = (np.concatenate(c) for c in zip(*self.held))
            self.held = []
            rows = SparseRows(index, tf, np.concatenate([[0], np.cumsum(sizes)]))
            yield from pack(rows, labels, marks, self.marks, *self.known)


@dataclass(frozen=True)
class Block:
    """Rows over the features ``names``, their labels and their marks."""

    rows: SparseRows
    names: np.ndarray
    labels: np.ndarray
    marks: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.labels)

    def may(self, only: Sequence[tuple[str, str, int]]) -> np.ndarray:
        """Which rows a restriction allows."""
        out = np.ones(len(self), bool)
        for column, op, value in only:
            out &= (self.marks[column] != value) if op == "!=" else (self.marks[column] <= value)
        return out

    def scores(self, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        return self.rows.times(weights[self.names]) + intercept


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        marks = batch.schema.names[len(COLUMNS):]
        for i in range(batch.num_rows):
            names, at, labels, idf = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (
                ("packed_names", np.int32), ("packed_at", np.int64), ("packed_labels", np.int32), ("packed_idf", np.float64)))
            n, rows = int(at[-1]), len(labels)
            index = _numbers(batch["packed_indices"][i], n).astype(np.int64)
            header = batch["packed_part"][i].as_buffer()
            if header.size:
                sublinear, parts = struct.unpack("<BB", header[:2].to_pybytes())
                part = np.frombuffer(header, np.uint8)[2:].astype(np.int64)
                row = np.repeat(np.arange(rows), np.diff(at))
                tf = _numbers(batch["packed_values"][i], n).astype(np.int64)
                value = grams.weights(row, rows, tf, idf[index], part[index], parts, bool(sublinear))
            else:
                value = np.frombuffer(batch["packed_values"][i].as_buffer(), np.float64)
            yield Block(SparseRows(index, value, at), names, labels, {c: np.frombuffer(batch[c][i].as_buffer(), np.float64) for c in marks})


def over(df: DataFrame, task: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """``task`` over the blocks of every task of the table."""
    # A task has one core; more BLAS threads would only get in each other's way.
    df.sparkSession.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    return df.mapInArrow(lambda batches: task(unpacked(batches)), out)
