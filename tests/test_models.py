import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.models import features as feat
from textmill.models import linear as lin
from textmill.models import scoring, tuning
from textmill.models import solver as sol
from textmill.plans.training import train
from textmill.config import ModelConfig, SearchGrids
from textmill.streaming.score import read_stream, score_stream

TOY = [
    ("python data science machine learning", "DS"), ("python data analysis pandas numpy", "DS"),
    ("java backend development spring", "BE"), ("java software engineering backend", "BE"),
    ("javascript react frontend developer", "FE"), ("javascript frontend web development", "FE"),
]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TOY)], "id long, text string, label string")


@pytest.fixture(scope="module")
def many(spark):
    """Rows of three noisy classes."""
    rng = np.random.default_rng(1)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(120):
        y = i % 3
        own = rng.choice(vocab[y * 9:y * 9 + 12], 6)
        rows.append((i, " ".join([*own, *rng.choice(vocab, 6)]), "abc"[y]))
    return spark.createDataFrame(rows, "id long, text string, label string")


def test_feature_shapes_and_labels(spark, toy):
    m = feat.TextFeatures(max_features=50, use_char_ngrams=False).fit(toy)
    assert m.vocabulary_size <= 50 and m.labels == ("BE", "DS", "FE") and m.num_classes == 3
    out = m.transform(toy).withColumn("back", m.decode_label("label_idx"))
    assert out.count() == 6 and all(r["back"] == r["label"] for r in out.collect())
    fresh = m.transform(spark.createDataFrame([("python machine learning",), ("zzz",)], "text string"))
    assert [len(r["indices"]) > 0 for r in fresh.collect()] == [True, False]


def test_tfidf_values(spark, toy):
    m = feat.TextFeatures(min_df=1, max_df=1.0, use_char_ngrams=False, ngram_range=(1, 1)).fit(toy)
    row = m.transform(spark.createDataFrame([("java java spring",)], "text string")).first()
    idf = {"java": math.log(7 / 3) + 1, "spring": math.log(7 / 2) + 1}
    raw = {"java": (1 + math.log(2)) * idf["java"], "spring": idf["spring"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    names = m.feature_names()
    got = {names[i]: v for i, v in zip(row["indices"], row["values"])}
    assert got == {k: pytest.approx(v / norm) for k, v in raw.items()}


def test_word_and_char_terms(spark):
    df = spark.createDataFrame([("ab cd ef",)], "t string")
    r = df.select(feat.word_terms("t", (1, 3)).alias("w"), feat.char_terms("t", (2, 5)).alias("c")).first()
    assert sorted(r["w"]) == sorted(["ab", "cd", "ef", "ab cd", "cd ef", "ab cd ef"])
    text = "ab cd ef"
    assert sorted(r["c"]) == sorted(text[i:i + n] for n in range(2, 6) for i in range(len(text) - n + 1))


def test_empty_vocabulary_is_an_error(toy):
    with pytest.raises(ValueError, match="min_df"):
        feat.TextFeatures(min_df=50).fit(toy)


def test_vector_round_trip(spark):
    df = spark.createDataFrame([([1, 4], [0.5, 2.0])], "i array<int>, v array<double>")
    vec = df.select(feat.pack_vector("i", "v", 6).alias("x"))
    assert vec.first()["x"].toArray().tolist() == [0, 0.5, 0, 0, 2.0, 0]
    back = vec.select(feat.unpack_vector("x").alias("s")).first()["s"]
    assert back["indices"] == [1, 4] and back["values"] == [0.5, 2.0]


@pytest.fixture(scope="module")
def trained(spark, many):
    m = feat.TextFeatures(min_df=1, max_df=1.0, use_char_ngrams=False).fit(many)
    rows = tuning.with_folds(m.transform(many).drop("text"), "id", 3).persist()
    yield m, rows
    rows.unpersist()


def dense(rows, n):
    data = rows.orderBy("id").collect()
    x = np.zeros((len(data), n))
    for r, d in enumerate(data):
        x[r, d["indices"]] = d["values"]
    return x, np.array([d["label_idx"] for d in data])


@pytest.mark.parametrize("loss", [sol.SQUARED_HINGE, sol.LOG, sol.SOFTMAX])
def test_solver_reaches_the_minimum(trained, loss):
    m, rows = trained
    n = m.vocabulary_size
    x, y = dense(rows, n)
    weights = np.array([1.0, 2.0, 1.0])
    total = float(weights[y].sum())
    p = sol.Problem(loss, 0.05, weights, total, None if loss == sol.SOFTMAX else 1, penalize_bias=True,
                    max_iter=200)
    (w, b), = sol.solve(rows, [p], n, 3, tol=1e-6)
    scores = x @ w + b
    if loss == sol.SOFTMAX:
        q = np.exp(scores - scores.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        slope = q * weights[y][:, None] / total
    else:
        s = np.where(y == 1, 1.0, -1.0)
        z = s * scores[:, 0]
        d = -2 * s * np.maximum(1 - z, 0) if loss == sol.SQUARED_HINGE else -s / (1 + np.exp(z))
        slope = (d * weights[y] / total)[:, None]
    grad = x.T @ slope + 0.05 * w
    assert np.abs(grad).max() < 2e-4


def test_trials_fitted_together_equal_trials_fitted_alone(trained):
    m, rows = trained
    k, v = m.num_classes, m.vocabulary_size
    trials = [lin.Trial("logistic", {"c": 1.0}), lin.Trial("svm", {"c": 1.0}, (("fold", "!=", 1),))]
    both = lin.fit_trials(rows, trials, k, v)
    alone = lin.fit_trials(rows.filter("fold <> 1"), [lin.Trial("svm", {"c": 1.0})], k, v)
    assert np.allclose(both[1].weights, alone[0].weights, atol=1e-6)


def test_winner_of_a_grid_equals_its_refit(trained):
    """The search, the refit and the curve end their fits by the same limit."""
    m, rows = trained
    k, v = m.num_classes, m.vocabulary_size
    for limit in (3, 1000):
        grid = tuning.Grid("SVM", "svm", ({"c": 0.5}, {"c": 1.0}), limit)
        best = tuning.grid_search(rows, [grid], k, v, 3)["SVM"]
        again = tuning.refit(rows, best, k, v, calibrated=False)
        assert best.max_iter == again.max_iter == limit
        assert np.allclose(best.heads[0].weights, again.heads[0].weights)


def test_accents_do_not_part_terms(spark):
    df = spark.createDataFrame([("Café naïve CAFE",), (None,)], "text string")
    got = df.select(feat.word_terms("text", (1, 1)).alias("w"), feat.char_terms("text", (4, 4)).alias("c")).collect()
    assert got[0]["w"] == ["cafe", "naive", "cafe"] and got[0]["c"].count("cafe") == 2 and got[1]["w"] is None


def test_naive_bayes_against_numpy(trained):
    m, rows = trained
    k, v = m.num_classes, m.vocabulary_size
    x, y = dense(rows, v)
    sums = lin.collect_sums(rows, k, v)[()]
    want = np.array([x[y == c].sum(axis=0) for c in range(k)])
    assert np.allclose(sums.sums, want) and sums.counts.tolist() == [40, 40, 40]
    head = lin.naive_bayes_head(sums, 0.5)
    smooth = want + 0.5
    assert np.allclose(head.weights.T, np.log(smooth / smooth.sum(axis=1, keepdims=True)))
    rest = lin.one_vs_rest_bayes_head(sums, 0.5)
    other = want.sum(axis=0) - want[0] + 0.5
    assert np.allclose(rest.weights[:, 0], np.log(smooth[0] / smooth[0].sum()) - np.log(other / other.sum()))


def test_fold_sums_add_up(trained):
    m, rows = trained
    per_fold = lin.collect_sums(rows, m.num_classes, m.vocabulary_size, "fold")
    whole = lin.collect_sums(rows, m.num_classes, m.vocabulary_size)[()]
    assert np.allclose(sum(p.sums for p in per_fold.values()), whole.sums)


def test_balanced_weights():
    assert lin.balanced_weights(np.array([1.0, 3.0, 0.0])).tolist() == [2.0, pytest.approx(2 / 3), 0.0]


def test_calibrated_probabilities(trained):
    m, rows = trained
    c = lin.calibrate(rows, m.num_classes, m.vocabulary_size, "LinearSVC", "svm", {"c": 1.0})
    ps = [r["p"] for r in rows.select(lin.probability(rows, c).alias("p")).collect()]
    assert all(abs(sum(p) - 1) < 1e-9 and min(p) >= 0 for p in ps)
    assert all((h.slope > 0).all() for h in c.heads)


def test_platt_is_the_maximum_likelihood(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.where(y == 1, 1.0, -1.0) + rng.normal(0, 1.5, 300)
    df = spark.createDataFrame([(0, float(a), [-float(b), float(b)]) for a, b in zip(y, s)],
                               "fold int, label_idx double, scores array<double>")
    slope, offset = lin.platt(df, 2, 1)[0, 1]
    pos = y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (300 - pos + 2))
    q = 1 / (1 + np.exp(-(slope * s + offset)))
    assert abs(((q - t) * s).sum()) < 1e-2 and abs((q - t).sum()) < 1e-2


def test_margins_have_no_probabilities(trained):
    m, rows = trained
    head = lin.Head(np.zeros((m.vocabulary_size, 3)), np.zeros(3), lin.MARGIN)
    with pytest.raises(ValueError, match="calibrate"):
        lin.probability(rows, lin.Classifier("x", (head,)))


def test_soft_vote(spark):
    ps = [F.array(*[F.lit(x) for x in p]) for p in ([0.7, 0.2, 0.1], [0.6, 0.3, 0.1], [0.3, 0.5, 0.2])]
    p = spark.range(1).select(tuning.vote(ps, [2, 2, 1]).alias("p")).first()["p"]
    assert p == [pytest.approx(0.58), pytest.approx(0.30), pytest.approx(0.12)]


def test_top_classes_keep_class_order_on_ties(spark):
    p = F.array(*[F.lit(x) for x in (0.2, 0.3, 0.3, 0.2)])
    r = spark.range(1).select(scoring.top_classes(p, ["a", "b", "c", "d"], 3).alias("t")).first()["t"]
    assert [x["category"] for x in r] == ["b", "c", "a"]


def test_five_classifiers_and_ensemble(spark, trained):
    m, rows = trained
    k, v = m.num_classes, m.vocabulary_size
    grids = SearchGrids(svm_c=(1.0,), lr_c=(0.5, 1.0), nb_alpha=(0.1, 1.0), sgd_alpha=(1e-3,))
    tuned = tuning.tune_all_classifiers(rows, k, v, grids=grids)
    assert list(tuned) == ["LinearSVC", "LogisticRegression", "MultinomialNB", "SGDClassifier", "OneVsRest_NB"]
    assert all(c.cv_mean > 0.5 for c in tuned.values())
    table = tuning.ranking(spark, tuned, 3).collect()
    assert len(table) == 3 and table[0]["cv_mean"] >= table[1]["cv_mean"] >= table[2]["cv_mean"]
    e = tuning.create_ensemble(rows, tuned, k, v, 3, grids)
    assert len(e.members) == 3 and sum(e.weights) == pytest.approx(3)
    scores = tuning.cross_validate(rows, 3, lambda only: tuning.create_ensemble(rows, tuned, k, v, 3, grids, only))
    assert len(scores) == 3 and min(scores) > 0.5
    curve = tuning.learning_curve(rows, tuned["LogisticRegression"], k, v, 3, 10).orderBy("step").collect()
    assert len(curve) == 10 and curve[-1]["train_rows"] == pytest.approx(80)
    bayes = tuning.learning_curve(rows, tuned["MultinomialNB"], k, v, 3, 10).orderBy("step").collect()
    assert [r["train_rows"] for r in bayes] == [r["train_rows"] for r in curve]


@pytest.mark.parametrize("classes", [2, 3])
def test_train_save_load_score_stream(spark, many, tmp_path, classes):
    corpus = many.filter(F.col("label") != "c") if classes == 2 else many
    config = ModelConfig(min_df=1, max_df=1.0, cv_folds=3, svm_c_values=(1.0,), lr_c_values=(1.0,),
                         use_ensemble=classes == 3, augmentation_factor=1, learning_curve_steps=3)
    result = train(corpus.withColumnRenamed("id", "row_id"), config=config)
    assert result.overall.first()["accuracy"] > 0.5
    result.save(str(tmp_path))
    loaded = scoring.TextClassifier.load(f"{tmp_path}/models")
    info = loaded.info(spark).first()
    assert info["num_classes"] == classes and info["model_type"] == ("ensemble" if classes == 3 else "single")
    scored = loaded.score(corpus).orderBy("id").collect()
    assert scored == result.classifier.score(corpus).orderBy("id").collect()
    for r in scored:
        assert 0 <= r["confidence"] <= 1 and r["tier"] in ("high", "medium", "low")
        assert abs(r["confidence"] - r["top_5_predictions"][0]["probability"]) < 1e-9
        assert isinstance(r["hierarchy_path"], list) and isinstance(r["requires_review"], bool)

    source = str(tmp_path / "in")
    corpus.select("id", "text").repartition(3).write.parquet(source)
    stream = read_stream(spark, source, "id long, text string", files_per_trigger=1)
    q = score_stream(stream, loaded, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["id"]: r["predicted_category"] for r in out.collect()} == {
        r["id"]: r["predicted_category"] for r in scored}


def test_missing_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Train"):
        scoring.TextClassifier.load(str(tmp_path / "nothing"))
