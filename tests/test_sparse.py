"""Sparse batches and the sums of gradients."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.models import linear, solver, sparse


def some_rows(n, width, seed=1):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(width, rng.integers(0, 9), replace=False)) for _ in range(n)]
    return [(r.tolist(), rng.normal(size=len(r)).tolist(), int(rng.integers(0, 3))) for r in rows]


def dense(rows, width):
    x = np.zeros((len(rows), width))
    for i, (idx, val, _) in enumerate(rows):
        x[i, idx] = val
    return x


@pytest.mark.parametrize("cells", [7, 4 << 20])
@pytest.mark.parametrize("n", [0, 1, 200])
def test_products(monkeypatch, cells, n):
    monkeypatch.setattr(sparse, "_CELLS", cells)
    rows = some_rows(n, 40)
    lists = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float64())))]
    x, rng = sparse.SparseRows.of(*lists), np.random.default_rng(2)
    w, slope, out = rng.normal(size=(41, 5)), rng.normal(size=(n, 5)), np.ones((41, 5))
    assert len(x) == n and np.allclose(x.times(w), dense(rows, 41) @ w)
    x.add_transposed(slope, out)
    assert np.allclose(out, 1 + dense(rows, 41).T @ slope)
    some = sparse.SparseRows.of(*[a.slice(n // 2) for a in lists])
    assert np.allclose(some.times(w), dense(rows, 41)[n // 2:] @ w)
    assert sparse.as_lists(slope).to_pylist() == slope.tolist()


def test_links_of_many_rows_are_those_of_each():
    scores = np.random.default_rng(3).normal(size=(20, 4)) * 5
    scores[3] = -1e9
    for head in (linear.Head(None, np.zeros(4), linear.SOFTMAX), linear.Head(None, np.zeros(4), linear.SIGMOID),
                 linear.Head(None, np.zeros(4), linear.SIGMOID, np.full(4, 2.0), np.arange(4.0))):
        p = head.probabilities(scores)
        assert np.allclose(p.sum(axis=1), 1)
        assert np.allclose(p, np.concatenate([head.probabilities(s[None]) for s in scores]))


@pytest.fixture(scope="module")
def features(spark):
    rows = some_rows(900, 60, 5)
    return spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)],
                                 "indices array<int>, values array<double>, label_idx int, fold int")


def problems():
    ones = np.ones(3)
    return [solver.Problem(solver.SOFTMAX, 0.01, ones, 900.0), solver.Problem(solver.LOG, 0.02, ones, 900.0, positive=1),
            solver.Problem(solver.SQUARED_HINGE, 0.02, ones, 600.0, positive=2, only=(("fold", "!=", 0),), penalize_bias=True)]


@pytest.mark.parametrize("driver_bytes, slice_bytes", [(8 << 20, 1 << 19), (0, 1 << 19), (0, 200)])
def test_gradients_are_those_of_dense_rows(spark, features, monkeypatch, driver_bytes, slice_bytes):
    monkeypatch.setattr(solver, "_DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(solver, "_SLICE_BYTES", slice_bytes)
    todo, w = problems(), np.random.default_rng(7).normal(size=(61, 5))
    loss, grad = solver._evaluate(features, todo, w, 3)
    rows = features.collect()
    x = np.hstack([dense([tuple(r) [:3] for r in rows], 60), np.ones((900, 1))])
    y = np.array([r["label_idx"] for r in rows])
    masks = np.ones((3, 900))
    masks[2] = [r["fold"] != 0 for r in rows]
    losses, slope = solver._block_gradient(x @ w, y, masks, todo, 3)
    assert np.allclose(loss, losses) and np.allclose(grad, x.T @ slope)
    bump = np.zeros_like(w)
    bump[5, 3] = 1e-5
    up, down = (solver._block_gradient(x @ (w + s * bump), y, masks, todo, 3)[0][1] for s in (1, -1))
    assert (up - down) / 2e-5 == pytest.approx(grad[5, 3], rel=1e-5)


def test_what_travels_does_not_grow_with_the_partitions(spark, features):
    todo, w = problems(), np.zeros((61, 5))
    sent, fitted = [], []
    for n in (8, 80):
        data = features.repartition(n).cache()
        parts, shared = solver.partial_sums(data, todo, w, 3)
        sent.append(parts.agg(F.sum(F.length("rows") + F.length("part"))).first()[0])
        fitted.append(solver.solve(data, todo, 60, 3, 1e-8))
    assert sent[1] <= sent[0] * 1.05
    for one, two in zip(*fitted):
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one, two))


def test_no_rows(spark, features):
    loss, grad = solver._evaluate(features.filter("fold > 5"), problems(), np.zeros((61, 5)), 3)
    assert not loss.any() and not grad.any()


def test_a_fit_reads_the_cells_of_its_rows_once(spark, features, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    steps, real = [], solver._evaluate
    monkeypatch.setattr(solver, "_evaluate", lambda *a: steps.append(1) or real(*a))
    counted = features.mapInArrow(seen, features.schema)
    fitted = solver.solve(counted, problems(), 60, 3, 1e-6)
    assert len(steps) > 3 and reads.value == 900
    for one, two in zip(fitted, solver.solve(features, problems(), 60, 3, 1e-6)):
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one, two))
