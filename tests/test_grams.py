"""N-grams counted as numbers equal those listed one by one."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.models import features as feat
from textmill.models import grams


def _texts(seed: int, n: int, letters: str) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(n)]


@pytest.mark.parametrize("span, size", [(1 << 62, 1 << 21), (1 << 22, 300)])
@pytest.mark.parametrize("name, ngram_range", [(feat.WORD, (1, 3)), (feat.WORD, (2, 2)), (feat.CHAR, (2, 5)), (feat.CHAR, (1, 1))])
def test_counts_equal_listed_terms(monkeypatch, span, size, name, ngram_range):
    monkeypatch.setattr(grams, "_SPAN", span)
    monkeypatch.setattr(grams, "_BYTES", size)
    texts = [" ".join(t.split()) for t in _texts(1, 150, "ab é中\U0001f600\0 ")]
    listed = []
    for t in texts:
        parts = list(t) if name == feat.CHAR else t.split(" ") if t else []
        listed.append(["".join(p) if name == feat.CHAR else " ".join(p)
                       for n in range(ngram_range[0], ngram_range[1] + 1) for p in zip(*[parts[i:] for i in range(n)])])
    tf, df = Counter(x for t in listed for x in t), Counter(x for t in listed for x in set(t))
    batch = pa.record_batch([pa.array(["zz", *texts], pa.string()).slice(1)], ["t"])
    got_tf, got_df = Counter(), Counter()
    for out in grams.counting(feat._KINDS[name], ngram_range)(iter([batch])):
        for term, d, f in zip(*(c.to_pylist() for c in out.columns)):
            got_df[term] += d
            got_tf[term] += f
    assert (got_tf, got_df) == (tf, df)
    terms = sorted(tf)[::2]
    idf = np.linspace(1.0, 2.0, len(terms))
    weigh = grams.weighing([grams.Vocabulary(feat._KINDS[name], terms, ngram_range)], [idf], True)
    place = {t: i for i, t in enumerate(terms)}
    for row, own in zip(weigh(batch.column(0)).to_pylist(), listed):
        cells = Counter(place[x] for x in own if x in place)
        w = np.array([(1 + np.log(cells[i])) * idf[i] for i in sorted(cells)])
        assert row["indices"] == sorted(cells)
        assert np.allclose(row["values"], w / np.sqrt((w * w).sum()) if len(w) else w, rtol=1e-12)


def test_spark_counts_equal_exploded_terms(spark):
    df = spark.createDataFrame([("Hé lo  wörld lo",), (None,), ("",), ("lo WORLD",)], "t string")
    for name, terms in ((feat.WORD, feat.word_terms("t", (1, 2))), (feat.CHAR, feat.char_terms("t", (2, 5)))):
        listed = df.select(terms.alias("x")).collect()
        tf = Counter(x for r in listed for x in r["x"] or [])
        got = feat.term_counts(df, name, "t", (1, 2) if name == feat.WORD else (2, 5)).collect()
        assert {r["term"]: r["tf"] for r in got} == tf


def test_labels_come_with_the_cells(spark, tables):
    """No join of the cells with the table again: the plan of the sums has one exchange."""
    from textmill.plans import registered

    sums = registered._bayes(spark, tables)[2]
    assert "Join" not in sums._jdf.queryExecution().toString()


def test_labels_are_encoded_without_texts(spark, tables):
    from textmill.plans import registered

    plan = registered.QUERIES["label_encoding"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
