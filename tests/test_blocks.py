"""Training and searches read one packed copy of the features, and fit what they can together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.config import ModelConfig, SearchGrids
from textmill.models import blocks, features as feat, linear as lin, solver, tuning
from textmill.plans import registered

MARKS = ("fold", "curve_fold", "cal_fold", "step")


@pytest.fixture(scope="module")
def both(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda".split()
    rows = [(i, " ".join(words[(i * k + i // 5) % (4 + i % 7)] for k in range(1, 4 + i % 9)), "abc"[i % 3]) for i in range(150)]
    texts = tuning.with_folds(spark.createDataFrame(rows, "id long, text string, label string"), "id", 3, label_col="label").persist()
    model = feat.TextFeatures(min_df=1, max_df=1.0, char_max_features=60).fit(texts)
    yield model, model.transform(texts).drop("text").persist(), model.packed(texts, MARKS).persist()


def test_blocks_hold_the_same_weights_in_less_room(both):
    model, lists, packed = both
    want = sorted((tuple(r["indices"]), tuple(r["values"]), r["label_idx"], *[r[m] for m in MARKS]) for r in lists.collect())
    got, size = [], 0
    for b in blocks.unpacked(iter(packed.toArrow().to_batches())):
        for k in range(len(b)):
            cells = slice(b.rows.at[k], b.rows.at[k + 1])
            got.append((tuple(b.names[b.rows.indices[cells]].tolist()), tuple(b.rows.values[cells].tolist()), int(b.labels[k]),
                        *[int(b.marks[m][k]) for m in MARKS]))
    cells = packed.agg(F.sum(F.length("packed_indices") + F.length("packed_values"))).first()[0]
    assert sorted(got) == want
    assert cells == 2 * sum(len(r[0]) for r in want)


def test_what_reads_blocks_equals_what_reads_lists(both):
    model, lists, packed = both
    k, v = model.num_classes, model.vocabulary_size
    rows = lambda t, *by: {key: (s.sums, s.counts) for key, s in lin.collect_sums(t, k, v, *by).items()}
    for by in ((), ("fold",), ("fold", "step")):
        a, b = rows(lists, *by), rows(packed, *by)
        assert a.keys() == b.keys()
        assert all(np.allclose(x, y) for key in a for x, y in zip(a[key], b[key]))
    trials = [lin.Trial("svm", {"c": 1.0}, (("fold", "!=", f),)) for f in range(3)] + [lin.Trial("logistic", {"c": 1.0}, (("step", "<=", 5),))]
    heads = [lin.fit_trials(t, trials, k, v) for t in (lists, packed)]
    assert all(np.allclose(x.weights, y.weights, atol=1e-6) for x, y in zip(*heads))
    judged = [lin.Classifier("t", (h,)) for h in heads[0]]
    a, b = ({r["trial"]: (r["n"], r["accuracy"]) for r in lin.trial_accuracy(t, judged, [0, 1, 2, 0]).collect()} for t in (lists, packed))
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t]) for t in a)
    curves = [sorted(map(tuple, tuning.bayes_learning_curve(t, k, v, 0.1, 3, 4).collect())) for t in (lists, packed)]
    assert all(x == pytest.approx(y) for x, y in zip(*curves)) and len(curves[0]) == len(curves[1]) == 4
    done = [lin.calibrate(t, k, v, "LinearSVC", "svm", {"c": 1.0}, only=(("fold", "!=", 0),)) for t in (lists, packed)]
    assert all(np.allclose(x.slope, y.slope, rtol=1e-4) and np.allclose(x.offset, y.offset, rtol=1e-4) for x, y in zip(done[0].heads, done[1].heads))
    assert lin.accuracy(lists, done[0], "fold", 0) == lin.accuracy(packed, done[0], "fold", 0)


def test_the_models_of_the_folds_are_fitted_in_one_go(both, monkeypatch):
    model, _, packed = both
    k, v = model.num_classes, model.vocabulary_size
    tuned = {"LinearSVC": lin.Classifier("LinearSVC", (lin.Head(np.zeros((v, k)), np.zeros(k), lin.MARGIN),), {"c": 1.0}, 0.9),
             "LogisticRegression": lin.Classifier("LogisticRegression", (lin.Head(np.zeros((v, k)), np.zeros(k), lin.SOFTMAX),), {"c": 1.0}, 0.8)}
    solved, real = [], solver.solve
    monkeypatch.setattr(solver, "solve", lambda *a: solved.append(1) or real(*a))
    onlys = [(), *[(("fold", "!=", f),) for f in range(3)]]
    together = tuning.create_ensembles(packed, tuned, k, v, 2, SearchGrids(), onlys)
    assert len(solved) == 1
    alone = tuning.create_ensemble(packed, tuned, k, v, 2, SearchGrids(), onlys[2])
    for x, y in zip(together[2].members, alone.members):
        assert all(np.allclose(a.weights, b.weights, atol=1e-6) for a, b in zip(x.heads, y.heads))


@pytest.mark.parametrize("query", ["tune_all_classifiers", "tune_hyperparameters"])
def test_searches_keep_no_lists_of_features(spark, tables, monkeypatch, query):
    small = ModelConfig(svm_c_values=(1.0,), lr_c_values=(1.0,), svm_max_iter=3, lr_max_iter=3)
    monkeypatch.setattr(registered, "_CONFIG", small)
    seen = []
    monkeypatch.setattr(tuning, query, lambda rows, *a: seen.append(rows) or {})
    monkeypatch.setattr(tuning, "ranking", lambda *a: None)
    registered.QUERIES[query](spark, tables)
    assert blocks.are_packed(seen[0]) and "values" not in seen[0].columns and not seen[0].storageLevel.useMemory
