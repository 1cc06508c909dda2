"""Repeated substrings against plain sorting and counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.llm import grouping, substrings
from textmill.llm.queries import QUERIES

DOCS = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60) | st.lists(st.integers(1, 30), max_size=60), st.integers(0, 24))
def test_suffix_arrays_are_sorted(symbols, small):
    symbols = [*symbols, 0]
    was, grouping._SMALL = grouping._SMALL, small
    try:
        got = grouping.suffix_array(np.array(symbols)).tolist()
    finally:
        grouping._SMALL = was
    assert got == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "abc" * 500 + "abd" * 500, "zyxwvutsrq" * 300, "".join(map(chr, range(1, 120))) * 20])
def test_suffix_arrays_of_periodic_texts(text):
    symbols = np.append(np.frombuffer(text.encode(), np.uint8).astype(np.int64), 0)
    order = grouping.suffix_array(symbols).tolist()
    assert sorted(order) == list(range(len(symbols)))
    tail = text + "\0"
    assert all(tail[a:] < tail[b:] for a, b in zip(order[::7], order[1::7]))


def plain(texts, length):
    """For each text what is left of its bytes and how many runs went, by counting all its windows."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 1)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((len(r), bytes(x for x, g in zip(r, gone) if not g), sum(gone[i] > gone[i - 1] for i in range(len(gone)))))
    return out


def check(spark, texts, length, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: r for r in substrings.without_repeated_substrings(
        docs, length=length, **how).select("row.doc_id", "n_bytes", "spans", "kept").collect()}
    for i, want in enumerate(plain(texts, length)):
        r = got[i]
        assert (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) == want, (i, texts[i])
        raw, cut = (texts[i] or "").encode(), bytearray()
        at = 0
        for s in r["spans"]:
            cut += raw[at:s["begin"]]
            at = s["end"]
        assert bytes(cut + raw[at:]) == want[1]


def some_texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    blocks = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(8)]
    texts = [" ".join(rnd.choice(blocks) if rnd.random() < 0.5 else word() for _ in range(rnd.randint(1, 12))) for _ in range(25)]
    return [*texts, texts[3], texts[4][1:], texts[5][:-1], "x" * 300, "x" * 37, "ab" * 90, "ba" * 80, None, "", "é" * 70]


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"task_bytes": 500}), (3, {"anchor_bytes": 0}), (4, {"task_bytes": 2000, "anchor_bytes": 400})])
def test_texts_against_counting(spark, seed, how):
    check(spark, some_texts(seed), 40, gram=8, **how)


def test_long_runs_are_several_pieces(spark):
    check(spark, ["q" * 9000, "q" * 4300 + "r", "r" + "qr" * 3000, "unlike" * 3], 30, gram=8)


def test_texts_that_differ_in_one_byte(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    check(spark, [base[:k] + "#" + base[k + 1:] for k in (0, 199, 200, 201, 450, 899)] + [base[100:299], base[100:300], base[700:]], 200)


def test_repeated_rows_rows_without_id_and_clashing_names(spark):
    text = "a passage that is long enough to be found again " * 6
    docs = spark.createDataFrame([(1, text + "1"), (1, text + "1"), (None, text + "1"), (None, "other" + text), (2, None)], DOCS)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "anchor", "k0", "k1", "kept", "low", "piece", "n", "id")])
    got = substrings.without_repeated_substrings(wide).select("row.*", F.col("kept").alias("left_over")).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["left_over"])) for r in got) == [(0, b""), (0, b"other"), (1, b""), (1, b""), (2, b"")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substrings.without_repeated_substrings(docs).count() == 0


def test_query_against_counting(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    want = dict(zip(texts, plain(texts.values(), 200)))
    got = QUERIES["op11_repeated_substrings"](spark, tables).collect()
    assert len(got) == len(texts)
    for r in got:
        n, kept, spans = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
