"""Contamination against plain Python, with short items, ties and nulls."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.llm import decontaminate

MARKS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return MARKS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    split = [(i, words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i, v in split:
            n = min(13, len(v))
            spans = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in spans:
                    hit |= set(range(k, k + n))
                    if i is not None:
                        found.add(str(i))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(60)] + ["É", "ß1", "漢"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 6, 7, 8, 12, 13, 14, 19, 20, 40])))) for i in range(40)]
    items += [(100, items[3][1]), (101, None), (102, ""), (103, "--- !!"), (None, items[10][1]), (104, "same " * 30), (105, "same " * 5)]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                w = words(rng.choice(items)[1])
                a = rng.randint(0, max(0, len(w) - 1))
                piece = w[a:a + rng.choice([5, 12, 13, 14, 30])]
                parts.append((", ".join(piece)).upper() if rng.random() < 0.3 else " ".join(piece))
            else:
                parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))))
        docs.append((d, rng.choice([" ", "\n", "."]).join(parts)))
    return docs + [(200, None), (201, ""), (202, "same " * 100), (203, "same " * 4), (203, "same " * 100), (None, "same " * 13)], items


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_equals_plain_python(spark, monkeypatch, bits):
    """Also with a filter so small that everything passes it."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = decontaminate.find_contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items), key=str)


def test_every_span_of_thirteen_words_is_found(spark):
    """An item's words at every offset of a document, with other words around."""
    item = [f"x{k}" for k in range(13)]
    docs = [(k, " ".join([f"a{j}" for j in range(k)] + item + [f"b{j}" for j in range(20 - k)])) for k in range(20)]
    got = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert all(r.n_hit == 13 and r.contaminated for r in got) and len(got) == 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.find_contamination(docs, none).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
    assert decontaminate.find_contamination(docs.filter("doc_id < 0"), none).count() == 0
