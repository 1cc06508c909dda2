"""Base counts and distances against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.llm import quality
from textmill.llm.queries import QUERIES
from textmill.llm.tables import read

WORD = re.compile("[^\x20\x09-\x0D]+")
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, r in enumerate(zip(w, w[1:], w[2:])):
        if runs[r] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", "  \n\t", "one", "one two", "a b c", "a b c a b c", "a a a a a", "a b a b a b x", "x y z\nx y z\n\nq\nq\n q",
         "#|<>* $5 %&", "ß é ñ 漢字 漢字 漢字 é", "a b c " * 400, "word\x0bsplit\x0cby\rall\twhite space", "a b c d",
         " ".join(f"t{i % 7} t{i % 11}" for i in range(500))]


def test_base_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = quality.judge(docs, quality.References([], [])).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [base(t) for t in TEXTS]
    assert [r.base_failed for r in got] == [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in map(base, TEXTS)]
    assert all(r.kept == (not r.base_failed) for r in got)


def test_registered_query_on_whole_tables(spark, tables):
    text = {r.doc_id: r.text for r in read(spark, tables, "documents").collect()}
    got = QUERIES["op1_distribution_divergence"](spark, tables).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == {i: base(t) for i, t in text.items()}
    assert all(not r.kept for r in got if r.base_failed)


def js(p, q):
    def part(x, m):
        return x * math.log2(x / m) if x else 0.0
    return math.sqrt(sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2)


def test_references_and_distances(spark):
    en = ["the cat and the dog sat on the mat Today 12"] * 3 + ["the end of the day and the night"] * 2
    de = ["der Hund und die Katze über der Straße"] * 4
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de] + [("???", None), (None, "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.language_references(docs, common=3)
    assert [r.language for r in refs.languages] == ["de", "en"]
    counts = {"en": Counter(w for t in en for w in t.split()), "de": Counter(w for t in de for w in t.split())}
    probe = "the dog und the cat"
    got = quality.judge(spark.createDataFrame([(1, probe)], "doc_id long, text string"), refs, min_chars=1, min_words=1).first()
    want = []
    for r in refs.languages:
        c = counts[r.language]
        top = sorted(c, key=lambda w: (-c[w], w))[:3]
        q = [c[w] / sum(c.values()) for w in top]
        p = [probe.split().count(w) / 5 for w in top]
        want.append((js([*p, 1 - sum(p)], [*q, 1 - sum(q)]), r))
    best = min(want, key=lambda x: x[0])
    assert got.word_distance == pytest.approx(best[0]) and got.nearest_language == best[1].language
    letters = sum(map(len, probe.split()))
    assert got.char_distance == pytest.approx(js([0] * len(quality.CLASSES) + [1.0], best[1].chars)) and got.word_chars == letters


def test_short_texts_are_not_judged_and_junk_fails(spark, tables):
    docs = read(spark, tables, "documents")
    refs = quality.language_references(docs)
    junk = " ".join(f"{i}!!{i * 7}%%" for i in range(200))
    got = quality.judge(spark.createDataFrame([(1, junk), (2, "12 34 !!")], "doc_id long, text string"), refs).orderBy("doc_id").collect()
    assert not got[0].kept and not got[0].base_failed and got[0].char_distance > 0.3
    assert got[1].char_distance is None and got[1].word_distance is None


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string").withColumn("words", F.lit(1))
    assert quality.judge(docs, quality.language_references(docs)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 5)], "doc_id long, text string, lang string, words string, n_words int")
    assert quality.judge(docs, quality.language_references(docs)).first().n_words == 3
