"""Language and toxicity: held-out accuracy, code-switched texts, and odd inputs."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import langid, sampling, toxicity
from textmill.llm.queries import QUERIES
from textmill.llm.tables import read


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark, larger):
    lang = {r.doc_id: r.lang for r in read(spark, larger, "documents").collect()}
    rows = [r for r in QUERIES["op3_crf_language"](spark, larger).collect() if r.held_out]
    assert len(rows) > 250 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def tagger(spark, larger):
    return langid.fit_languages(read(spark, larger, "documents"))


def test_code_switched_words(spark, larger, tagger):
    rows = read(spark, larger, "documents").filter("length(text) > 600").orderBy(F.desc("doc_id")).toPandas()
    one = {k: g["text"].iloc[0].replace("|", "").split()[:60] for k, g in rows.groupby("lang")}
    text = " ".join(one["en"][:15] + one["fr"][:15] + one["de"][:15])
    p, before = tagger.tag(pa.array([text]))
    got = [tagger.labels[k] for k in p.argmax(axis=1)]
    raw = langid._LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = langid.word_spans(raw, np.array([0, len(raw)]), langid._GAPS)
    cuts = [len(" ".join(one["en"][:15]).encode()), len(" ".join(one["en"][:15] + one["fr"][:15]).encode())]
    want = ["en" if s < cuts[0] else "fr" if s < cuts[1] else "de" for s in start]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.75
    assert tagger.languages(pa.array([text]))[3][0] >= 2


def test_texts_without_letters_and_rows_with_clashing_names(spark, tagger):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 ... 3", "c"), (4, "🙂 🙂", "d"), (5, "the " * 300, "e")],
                                 "doc_id long, text string, score string")
    got = {r.row.doc_id: r for r in langid.identify(docs, tagger).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[5].lang_pred == "en" and got[5].row.score == "e" and got[5].n_words == 300 and got[5].n_switches == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.fit_languages(docs) is None
    assert langid.identify(docs, None).first().lang_pred == "und"
    assert langid.identify(docs.filter("doc_id < 0"), None).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(3)
    scores, move = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    weight = {path: np.exp(sum(scores[t, 0, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
              for path in product(range(3), repeat=4)}
    want = np.array([[sum(w for p, w in weight.items() if p[t] == k) for k in range(3)] for t in range(4)]) / sum(weight.values())
    assert np.allclose(langid.forward_backward(scores, np.array([4]), move)[0][:, 0], want)
    assert np.allclose(langid.marginals(scores, np.array([4]), move)[:, 0], want)


def test_runs_of_different_lengths_do_not_disturb_each_other():
    rng = np.random.default_rng(4)
    scores, move = rng.normal(size=(6, 2, 3)), rng.normal(size=(3, 3))
    both = langid.marginals(scores, np.array([6, 3]), move)
    assert np.allclose(both[:3, 1], langid.marginals(scores[:3, 1:], np.array([3]), move)[:, 0])


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in read(spark, d, "labels").collect()}
    rows = [r for r in QUERIES["op7_cnn_toxicity"](spark, d).collect() if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert hit >= 0.8 * sum(toxic[r.doc_id] for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def toy(n=240):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        words = [f"word{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}" for _ in range(30)]
        if i % 3 == 0:
            words[rng.integers(30)] = "nasty"
        rows.append((i, " ".join(words), int(i % 3 == 0), "en" if i % 2 else None))
    return pd.DataFrame(rows, columns=["doc_id", "text", "toxic", "lang"])


def test_network_learns_a_word_anywhere():
    model = toxicity.ToxicityModel.fit(toy(), epochs=12)
    score, _ = model.scores(pa.array(["wordaa " * 200 + "nasty", "nasty", "Nasty!", "wordaa wordab", "", None]))
    assert (score[:3] >= 0.7).all() and (score[3:] < 0.7).all()


def test_one_kind_of_label_or_none(spark):
    some = toy().assign(toxic=1)
    assert toxicity.ToxicityModel.fit(some) == 1.0 and toxicity.ToxicityModel.fit(some[:0]) == 0.0
    docs = spark.createDataFrame([(1, None, 5)], "doc_id long, text string, score int")
    r = toxicity.score_toxicity(docs, 0.0).first()
    assert (r.score, r.predicted, r.row.score) == (0.0, 0, 5)
    assert toxicity.score_toxicity(docs.filter("doc_id < 0"), 0.0).count() == 0


def test_best_threshold_is_between_the_kinds():
    p, truth = np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])
    assert toxicity.best_threshold(p, truth, np.ones(4)) == pytest.approx(0.55)
    assert toxicity.best_threshold(np.array([0.4, 0.4]), np.array([1.0, 0]), np.ones(2)) == pytest.approx(0.2)


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    one = sampling.labelled_sample(rows, "y", 100, 10, 2)
    assert one.equals(sampling.labelled_sample(rows.repartition(7), "y", 100, 10, 2))
    assert one.groupby("y").size().between(60, 140).all()
