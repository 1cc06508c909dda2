"""Only runs that may repeat leave their task, and a full bitmap loses none."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import paragraphs


class Shared:
    def __init__(self, value):
        self.value = value


def _rows():
    rng = random.Random(5)
    words = lambda n: [f"q{rng.randrange(9000)}" for _ in range(n)]
    passage = words(70)
    return [(d, " ".join(words(300) + (passage if d < 2 else []) + words(300))) for d in range(20)]


def test_runs_of_other_anchors_stay_in_their_task(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    anchors = docs.mapInArrow(paragraphs._anchors(50), "anchor long, doc_id long")
    crowded = anchors.groupBy("anchor").count().filter("count > 1").select("anchor")
    known = {r.anchor for r in crowded.collect()}
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    out = list(paragraphs._anchored(50, Shared(paragraphs._sieve(crowded)[0]))([batch]))
    sent = [a for b in out for a in b.column(0).to_pylist()]
    assert known and known <= set(sent)
    assert len(sent) < 0.2 * anchors.count()


@pytest.mark.parametrize("bits", [6, 27])
def test_passages_are_the_same_with_any_bitmap(spark, monkeypatch, bits):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    sieve = paragraphs._sieve
    monkeypatch.setattr(paragraphs, "_sieve", lambda anchors: sieve(anchors, bits))
    got = [(r.doc_id, r.n_words, r.keeper_doc_id, r.removed, r.start) for r in paragraphs.repeated_passages(docs).collect()]
    assert sorted(got) == [(0, 70, 0, False, 300), (1, 70, 0, True, 300)]


def test_smallest_of_runs():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for n in (1, 2, 7, 25):
        assert np.array_equal(paragraphs._lowest(x, n), np.lib.stride_tricks.sliding_window_view(x, n).min(axis=1))
