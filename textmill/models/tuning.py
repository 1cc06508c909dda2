"""Grid search, ranking, ensembles and learning curves.

Folds come with the table as a ``fold`` column.  The trials of a grid are fitted
together and then all judged in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import ModelConfig, SearchGrids
from textmill.models import blocks as B
from textmill.models import linear as L
from textmill.operators.split import fold_of, stratified_rank

def with_folds(df: DataFrame, id_col: str, k: int, seed: int = 42, calibration: int = 3,
               steps: int = 10, label_col: str = "label_idx", curve: int = 5) -> DataFrame:
    """Adds ``fold``, ``curve_fold``, ``cal_fold`` and ``step``, all stratified by label.

    One ranking serves all: rank mod k (mod ``curve`` for the learning curve), rank
    div k mod the calibration folds, and the tenth of the label the rank falls into.  Ranking shuffles the
    rows, so it is cheaper on texts than on their features.
    """
    ranked = stratified_rank(df, id_col, label_col, seed)
    per_fold = F.floor((F.col("label_rank") - 1) / k)
    return (
        ranked.withColumn("fold", fold_of("label_rank", k))
        .withColumn("curve_fold", fold_of("label_rank", curve))
        .withColumn("cal_fold", F.pmod(per_fold, F.lit(calibration)).cast("int"))
        .withColumn(
            "step",
            F.least(
                F.ceil(F.col("label_rank") * steps / F.col("label_n")), F.lit(steps)
            ).cast("int"),
        )
        .drop("label_rank", "label_n")
    )


def _accuracies(df: DataFrame, trials: Sequence[L.Classifier], folds: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(trials))
    for part in L.in_batches(trials):
        own, on = [trials[i] for i in part], [folds[i] for i in part]
        for r in L.trial_accuracy(df, own, on).collect():  # one row per trial
            out[part[r["trial"]]] = r["accuracy"]
    return out


@dataclass(frozen=True)
class Grid:
    name: str
    kind: str
    points: tuple[dict, ...]
    max_iter: int = 1000


def grid_search(
    df: DataFrame, grids: Sequence[Grid], n_classes: int, n_terms: int, k: int,
    only: tuple = (),
) -> dict[str, L.Classifier]:
    """Best point of each grid by mean fold accuracy; the first wins a tie.

    All points of all grids, on all folds and on all rows, are fitted together,
    so several searches cost the passes of the slowest and the winners need none.
    """
    trials, folds, whole = [], [], []
    for grid in grids:
        for point in grid.points:
            for f in range(k):
                trials.append(L.Trial(grid.kind, point, (*only, ("fold", "!=", f)), grid.max_iter))
                folds.append(f)
            whole.append(L.Trial(grid.kind, point, only, grid.max_iter))
    heads = L.fit_trials(df, trials + whole, n_classes, n_terms)
    judged = [L.Classifier("trial", (h,)) for h in heads[: len(folds)]]
    scores = _accuracies(df, judged, folds).reshape(len(whole), k)
    out, at = {}, 0
    for grid in grids:
        own = scores[at : at + len(grid.points)]
        best = int(np.argmax(own.mean(axis=1)))
        out[grid.name] = L.Classifier(
            grid.name, (heads[len(folds) + at + best],), dict(grid.points[best]),
            float(own[best].mean()), float(own[best].std()), grid.max_iter,
        )
        at += len(grid.points)
    return out


def bayes_search(
    df: DataFrame, name: str, alphas: Sequence[float], n_classes: int, n_terms: int, k: int,
    make: Callable[[L.ClassSums, float], L.Head] = L.naive_bayes_head,
    sums: dict | None = None,
) -> L.Classifier:
    """Naive Bayes over a grid of ``alpha``: one aggregation and one scoring pass.

    The sums of all rows but a fold are the total minus the fold.
    """
    per_fold = sums or L.collect_sums(df, n_classes, n_terms, "fold")
    parts = [per_fold[(f,)] for f in range(k)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    trials, folds = [], []
    for alpha in alphas:
        for f in range(k):
            trials.append(L.Classifier(name, (make(total - parts[f], alpha),)))
            folds.append(f)
    scores = _accuracies(df, trials, folds).reshape(len(alphas), k)
    best = int(np.argmax(scores.mean(axis=1)))
    return L.Classifier(
        name, (make(total, alphas[best]),), {"alpha": alphas[best]},
        float(scores[best].mean()), float(scores[best].std()),
    )


def tune_hyperparameters(
    df: DataFrame, n_classes: int, n_terms: int, config: ModelConfig = ModelConfig(),
) -> dict[str, L.Classifier]:
    """SVM and logistic regression over C, naive Bayes at its one alpha."""
    k = config.cv_folds
    out = grid_search(
        df,
        [
            Grid("SVM", "svm", tuple({"c": c} for c in config.svm_c_values), config.svm_max_iter),
            Grid("LR", "logistic", tuple({"c": c} for c in config.lr_c_values), config.lr_max_iter),
        ],
        n_classes, n_terms, k,
    )
    out["NB"] = bayes_search(df, "NB", [config.nb_alpha], n_classes, n_terms, k)
    return out


def tune_all_classifiers(
    df: DataFrame, n_classes: int, n_terms: int, config: ModelConfig = ModelConfig(),
    grids: SearchGrids = SearchGrids(), fast_mode: bool = True,
) -> dict[str, L.Classifier]:
    """Five classifiers, each at its best grid point."""
    k = config.fast_cv_folds if fast_mode else config.cv_folds
    sgd = tuple({"alpha": a, "loss": loss} for a in grids.sgd_alpha for loss in grids.sgd_loss)
    linear = grid_search(
        df,
        [
            Grid("LinearSVC", "svm", tuple({"c": c} for c in grids.svm_c), grids.svm_max_iter),
            Grid("LogisticRegression", "logistic", tuple({"c": c} for c in grids.lr_c), grids.lr_max_iter),
            Grid("SGDClassifier", "sgd", sgd, grids.sgd_max_iter),
        ],
        n_classes, n_terms, k,
    )
    sums = L.collect_sums(df, n_classes, n_terms, "fold")
    bayes = bayes_search(df, "MultinomialNB", grids.nb_alpha, n_classes, n_terms, k, sums=sums)
    rest = bayes_search(
        df, "OneVsRest_NB", [bayes.params["alpha"]], n_classes, n_terms, k,
        make=L.one_vs_rest_bayes_head, sums=sums,
    )
    return {
        "LinearSVC": linear["LinearSVC"],
        "LogisticRegression": linear["LogisticRegression"],
        "MultinomialNB": bayes,
        "SGDClassifier": linear["SGDClassifier"],
        "OneVsRest_NB": rest,
    }


def ranking(spark: SparkSession, tuned: dict[str, L.Classifier], top_n: int | None = None) -> DataFrame:
    """(rank, model, params, cv_mean, cv_std); equal scores keep the trial order."""
    rows = [
        (i, name, ", ".join(f"{k}={v}" for k, v in sorted(c.params.items())), c.cv_mean, c.cv_std)
        for i, (name, c) in enumerate(tuned.items())
    ]
    table = spark.createDataFrame(
        rows, "trial int, model string, params string, cv_mean double, cv_std double"
    ).orderBy(F.desc("cv_mean"), "trial")
    return table if top_n is None else table.limit(top_n)


def best_of(tuned: dict[str, L.Classifier], top_n: int = 1) -> list[L.Classifier]:
    """The highest mean accuracies; equal scores keep the trial order."""
    return sorted(tuned.values(), key=lambda c: -c.cv_mean)[:top_n]


_KINDS = {"LinearSVC": "svm", "SVM": "svm", "SGDClassifier": "sgd",
          "LogisticRegression": "logistic", "LR": "logistic"}


def refit(
    df: DataFrame, c: L.Classifier, n_classes: int, n_terms: int, calibrated: bool = True,
    grids: SearchGrids = SearchGrids(), only: tuple = (),
) -> L.Classifier:
    """The classifier at its parameters, fitted on the rows ``only`` allows.

    A classifier that gives margins only is calibrated if asked.
    """
    return refits(df, [(c, only)], n_classes, n_terms, calibrated, grids)[0]


def refits(
    df: DataFrame, jobs: Sequence[tuple[L.Classifier, tuple]], n_classes: int, n_terms: int,
    calibrated: bool = True, grids: SearchGrids = SearchGrids(),
) -> list[L.Classifier]:
    """:func:`refit` of each classifier on the rows of its ``only``: the linear ones are fitted
    together, and so are their sigmoids, so many of them cost the passes of the slowest."""
    trials, spans, sums = [], [], {}
    for c, only in jobs:
        kind, start = _KINDS.get(c.name), len(trials)
        if kind is None:
            if only not in sums:
                parts = L.collect_sums(df, n_classes, n_terms, *[column for column, _, _ in only])
                chosen = [p for key, p in parts.items() if all(
                    k != value if op == "!=" else k <= value for k, (_, op, value) in zip(key, only))]
                sums[only] = reduce(lambda a, b: a + b, chosen)
        elif kind != "logistic" and calibrated:
            trials += L.calibration_trials(kind, c.params, grids.calibration_folds, c.max_iter, only)
        else:
            trials.append(L.Trial(kind, c.params, only, c.max_iter))
        spans.append(slice(start, len(trials)))
    heads = L.fit_trials(df, trials, n_classes, n_terms) if trials else []
    out, margins = [], []
    for i, ((c, only), span) in enumerate(zip(jobs, spans)):
        kind = _KINDS.get(c.name)
        if kind is None:
            make = L.one_vs_rest_bayes_head if c.name == "OneVsRest_NB" else L.naive_bayes_head
            out.append(replace(c, heads=(make(sums[only], c.params["alpha"]),)))
            continue
        out.append(replace(c, heads=tuple(heads[span])))
        if kind != "logistic" and calibrated:
            margins.append(i)
    if margins:
        done = L.calibrated(df, [out[i] for i in margins], [jobs[i][1] for i in margins], n_classes)
        for i, c in zip(margins, done):
            out[i] = c
    return out


def create_ensemble(
    df: DataFrame, tuned: dict[str, L.Classifier], n_classes: int, n_terms: int,
    top_n: int = 5, grids: SearchGrids = SearchGrids(), only: tuple = (),
) -> L.Ensemble:
    """Soft vote of the best classifiers, weighted by their score.

    Classifiers that give margins only are calibrated first; the others are
    fitted already, unless ``only`` asks for a part of the rows.
    """
    return create_ensembles(df, tuned, n_classes, n_terms, top_n, grids, [only])[0]


def create_ensembles(
    df: DataFrame, tuned: dict[str, L.Classifier], n_classes: int, n_terms: int,
    top_n: int, grids: SearchGrids, onlys: Sequence[tuple],
) -> list[L.Ensemble]:
    """:func:`create_ensemble` on the rows of each ``only``, all fitted together."""
    best = best_of(tuned, top_n)
    jobs = [(c, only) for only in onlys for c in best if only or not c.gives_probabilities]
    fitted = iter(refits(df, jobs, n_classes, n_terms, True, grids))
    scores = [c.cv_mean for c in best]
    weights = tuple(s / sum(scores) * len(scores) for s in scores)
    return [L.Ensemble(tuple(next(fitted) if only or not c.gives_probabilities else c for c in best), weights) for only in onlys]


def vote(probabilities: Sequence, weights: Sequence[float]):
    """Weighted mean of probability arrays as a column expression."""
    total = float(sum(weights))
    out = F.transform(probabilities[0], lambda p: p * (weights[0] / total))
    for p, w in zip(probabilities[1:], weights[1:]):
        share = w / total
        out = F.zip_with(out, p, _plus(share))
    return out


def _plus(share: float):
    return lambda a, b: a + b * share


def cross_validate(
    df: DataFrame, k: int, fit: Callable[[tuple], L.Classifier | L.Ensemble]
) -> list[float]:
    """Accuracy on each fold of a model fitted on the other folds: ``fit(only)``."""
    models = [fit((("fold", "!=", f),)) for f in range(k)]
    return [L.accuracy(df, model, "fold", f) for f, model in enumerate(models)]


def learning_curve(
    df: DataFrame, c: L.Classifier, n_classes: int, n_terms: int, k: int = 5, steps: int = 10,
) -> DataFrame:
    """Accuracy on the training rows and on the held-out fold for growing shares
    of the training rows: nested, stratified subsets.

    Naive Bayes takes one aggregation; other kinds are fitted all together.
    """
    if c.name not in _KINDS:
        return bayes_learning_curve(df, n_classes, n_terms, c.params["alpha"], k, steps)
    jobs = [(s, f) for s in range(1, steps + 1) for f in range(k)]
    trials = [
        L.Trial(_KINDS[c.name], c.params, (("fold", "!=", f), ("step", "<=", s)), c.max_iter)
        for s, f in jobs
    ]
    heads = L.fit_trials(df, trials, n_classes, n_terms)
    return curve_table(df, [L.Classifier(c.name, (h,)) for h in heads], jobs)


def bayes_learning_curve(
    df: DataFrame, n_classes: int, n_terms: int, alpha: float, k: int = 5, steps: int = 10
) -> DataFrame:
    """The learning curve of naive Bayes: one aggregation, one scoring pass."""
    parts = L.collect_sums(df, n_classes, n_terms, "fold", "step")
    empty = L.ClassSums(np.zeros((n_classes, n_terms)), np.zeros(n_classes))
    jobs, trials = [], []
    for s in range(1, steps + 1):
        for f in range(k):
            total = empty
            for (fold, step), part in parts.items():
                if fold != f and step <= s:
                    total = total + part
            jobs.append((s, f))
            trials.append(L.Classifier("NB", (L.naive_bayes_head(total, alpha),)))
    return curve_table(df, trials, jobs)


def _curve_scores(
    df: DataFrame, trials: Sequence[L.Classifier], jobs: Sequence[tuple[int, int]]
) -> DataFrame:
    """(at_step, at_fold, train_rows, train_acc, valid_acc) in one pass."""
    if B.are_packed(df):
        steps, folds = (np.array(x)[None] for x in zip(*jobs))

        def judged(b: B.Block) -> list[np.ndarray]:
            held = b.marks["fold"][:, None] == folds
            return [~held & (b.marks["step"][:, None] <= steps), held]

        of_job = F.element_at(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in jobs]), F.col("trial") + 1)
        n, share = F.col("n"), F.try_divide(F.col("hits"), F.col("n"))
        return L.block_hits(df, trials, judged).select("*", of_job.alias("job")).groupBy(
            F.col("job.s").alias("at_step"), F.col("job.f").alias("at_fold")).agg(
            F.sum(F.when(F.col("part") == 0, n)).alias("train_rows"),
            F.max(F.when(F.col("part") == 0, share)).alias("train_acc"),
            F.max(F.when(F.col("part") == 1, share)).alias("valid_acc"))
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in jobs])
    rows = (
        L.guesses(df, trials)
        .select(
            "fold", "step", "label_idx",
            F.posexplode(F.arrays_zip(F.col("guess"), table.alias("job"))),
        )
        .select(
            F.col("col.job.s").alias("at_step"),
            F.col("col.job.f").alias("at_fold"),
            (F.col("col.guess") == F.col("label_idx")).cast("double").alias("hit"),
            (F.col("fold") == F.col("col.job.f")).alias("valid"),
            (F.col("step") <= F.col("col.job.s")).alias("reached"),
        )
    )
    train = ~F.col("valid") & F.col("reached")
    return rows.groupBy("at_step", "at_fold").agg(
        F.sum(train.cast("long")).alias("train_rows"),
        F.avg(F.when(train, F.col("hit"))).alias("train_acc"),
        F.avg(F.when(F.col("valid"), F.col("hit"))).alias("valid_acc"),
    )


def curve_table(
    df: DataFrame, trials: Sequence[L.Classifier], jobs: Sequence[tuple[int, int]],
    gap: float = ModelConfig().overfit_gap,
) -> DataFrame:
    """(step, train_rows, train_mean, train_std, valid_mean, valid_std, overfit)."""
    per_fold = None
    for part in L.in_batches(trials):
        scores = _curve_scores(df, [trials[i] for i in part], [jobs[i] for i in part])
        per_fold = scores if per_fold is None else per_fold.unionByName(scores)
    return (
        per_fold.groupBy(F.col("at_step").alias("step"))
        .agg(
            F.avg("train_rows").alias("train_rows"),
            F.avg("train_acc").alias("train_mean"),
            F.stddev_pop("train_acc").alias("train_std"),
            F.avg("valid_acc").alias("valid_mean"),
            F.stddev_pop("valid_acc").alias("valid_std"),
        )
        .withColumn("overfit", F.col("train_mean") - F.col("valid_mean") > gap)
    )
