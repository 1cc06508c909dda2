"""Rows with many cells are multiplied as matrices, with the results of single cells."""

import numpy as np
import pyarrow as pa
import pytest

from textmill.models import sparse


def _rows(rng, n, height, cells):
    index = [rng.choice(height, rng.integers(0, cells + 1), replace=True) for _ in range(n)]
    value = [rng.normal(size=len(i)) for i in index]
    return sparse.SparseRows.of(pa.array([i.tolist() for i in index], pa.list_(pa.int32())), pa.array([v.tolist() for v in value], pa.list_(pa.float64())))


@pytest.mark.parametrize("cells, pays", [(200, True), (2, False)])
def test_products_by_matrix_equal_those_by_cell(monkeypatch, cells, pays):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(sparse, "_CELLS", 3000)
    x, w, slope = _rows(rng, 50, 400, cells), rng.normal(size=(400, 30)), rng.normal(size=(50, 30))
    assert x._dense_pays(*w.shape) == pays
    whole = np.zeros((50, 400))
    np.add.at(whole, (np.repeat(np.arange(50), np.diff(x.at)), x.indices), x.values)
    grad = np.ones((400, 30))
    x.add_transposed(slope, grad)
    assert np.allclose(x.times(w), whole @ w) and np.allclose(grad, 1 + whole.T @ slope)
