"""Sparse rows of an Arrow batch as one matrix.

A feature row is two lists, ``indices`` and ``values``.  A batch of them already is a
compressed sparse matrix: the lists' flat children and their offsets.  Products go over
all rows at once, in runs of bounded size, and no Python object is made for a row.  Rows
with many cells are laid out as matrices, whose products are cheaper than gathered cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Numbers that a product holds at a time (32 MB).
_CELLS = 4 << 20


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


@dataclass(frozen=True)
class SparseRows:
    indices: np.ndarray
    values: np.ndarray
    #: Where each row begins, and the last one ends.
    at: np.ndarray

    @staticmethod
    def of(indices: pa.Array, values: pa.Array) -> SparseRows:
        """From list columns without nulls."""
        (i, at), (v, _) = _flat(indices), _flat(values)
        return SparseRows(i, v, at)

    def __len__(self) -> int:
        return len(self.at) - 1

    def _runs(self, width: int) -> Iterator[tuple[int, int]]:
        """Runs of rows whose products with ``width`` columns are of bounded size."""
        most, a = max(1, _CELLS // max(1, width)), 0
        while a < len(self):
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + most, "right")) - 1)
            yield a, b
            a = b

    def _dense_pays(self, height: int, width: int) -> bool:
        """Whether products of whole rows are cheaper than of their cells: a cell of a matrix
        product costs some 45th of one that is gathered, and a row must be laid out first."""
        return height * (width + 15) < 45 * len(self.indices) / max(1, len(self)) * width

    def _dense(self, height: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of rows as matrices of bounded size."""
        most = max(1, _CELLS // height)
        for a in range(0, len(self), most):
            b = min(a + most, len(self))
            low, high = self.at[a], self.at[b]
            cell = np.repeat(np.arange(b - a, dtype=np.int64) * height, np.diff(self.at[a:b + 1])) + self.indices[low:high]
            yield a, b, np.bincount(cell, self.values[low:high], (b - a) * height).reshape(b - a, height)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """rows @ weights."""
        out = np.zeros((len(self), weights.shape[1]))
        if self._dense_pays(*weights.shape):
            for a, b, rows in self._dense(len(weights)):
                out[a:b] = rows @ weights
            return out
        for a, b in self._runs(weights.shape[1]):
            low, high = self.at[a], self.at[b]
            some = np.flatnonzero(np.diff(self.at[a:b + 1]))
            if len(some):
                cells = weights[self.indices[low:high]] * self.values[low:high, None]
                out[a + some] = np.add.reduceat(cells, self.at[a + some] - low, axis=0)
        return out

    def descend(self, weights: np.ndarray, slope_of: Callable[[int, int, np.ndarray], np.ndarray], out: np.ndarray) -> None:
        """out += rows.T @ slope, where slope_of(first row, last row, rows @ weights) gives the slope of a
        run of rows: matrices are laid out once for both products."""
        if self._dense_pays(*weights.shape):
            for a, b, rows in self._dense(len(weights)):
                out += rows.T @ slope_of(a, b, rows @ weights)
            return
        self.add_transposed(slope_of(0, len(self), self.times(weights)), out)

    def add_transposed(self, slope: np.ndarray, out: np.ndarray) -> None:
        """out += rows.T @ slope."""
        if self._dense_pays(*out.shape):
            for a, b, rows in self._dense(len(out)):
                out += rows.T @ slope[a:b]
            return
        for a, b in self._runs(slope.shape[1]):
            low, high = self.at[a], self.at[b]
            if low == high:
                continue
            order = np.argsort(self.indices[low:high], kind="stable")
            row = np.repeat(np.arange(a, b), np.diff(self.at[a:b + 1]))[order]
            index = self.indices[low:high][order]
            first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
            out[index[first]] += np.add.reduceat(slope[row] * self.values[low:high][order, None], first, axis=0)


def as_lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[:n + 1]),
                                    pa.array(np.ascontiguousarray(rows, np.float64).ravel()))
