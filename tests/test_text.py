import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.fixed_values import HTML_ENTITIES, STOPWORDS
from textmill.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, options, expected",
    [
        ("Check out my portfolio at https://example.com and contact me", {}, "check portfolio contact"),
        ("Contact me at john.doe@example.com for more info", {}, "contact info"),
        ("<div class='resume'><p>Software Engineer</p></div>", {}, "software engineer"),
        ("I am a software engineer and I have worked with many teams", {},
         "software engineer worked many teams"),
        ("I am a software engineer and I have worked with many teams", {"remove_stops": False},
         "am software engineer and have worked with many teams"),
        ("I do ML and AI at a top company", {"remove_stops": False, "min_token_length": 3},
         "and top company"),
        ("R&amp;D &amp;lt;b&gt; café", {}, "caf"),
        ("", {}, ""),
    ],
)
def test_preprocess(spark, text, options, expected):
    assert one(spark, text, tx.preprocess("t", **options)) == expected


def test_entities_are_decoded_in_order(spark):
    assert one(spark, "&amp;lt;b&amp;gt;", tx.clean_html("t")) == "<b>"


def test_text_hash(spark):
    for t in ("Hello   World ", " hello world"):
        assert one(spark, t, tx.text_hash("t")) == "5eb63bbbe01eeed093cb22bb8f5acdc3"


def test_short_text_is_its_own_shingle(spark):
    assert one(spark, "Ab", tx.text_shingles("t")) == ["ab"]
    assert sorted(one(spark, "abab", tx.text_shingles("t"))) == ["aba", "bab"]


def test_signature_keeps_the_same_shingles_everywhere(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    kept = one(spark, text, tx.text_shingles("t", 10))
    assert len(kept) == 10
    assert kept == one(spark, text, tx.text_shingles("t", 10))


def test_jaccard(spark):
    def j(a, b):
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        return df.select(tx.jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"]

    assert j(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)
    assert j([], ["b"]) == 0.0


def plain_preprocess(text):
    text = re.sub("<[^>]+>", " ", text)
    for entity, char in HTML_ENTITIES:
        text = text.replace(entity, char)
    text = re.sub(r"https?://\S+|www\.\S+", " ", text)
    text = re.sub(r"\S+@\S+\.\S+", " ", text).lower()
    words = re.sub("[^a-z]", " ", text).split()
    return " ".join(w for w in words if w not in set(STOPWORDS) and len(w) > 1)


ALPHABET = st.sampled_from(list("aAbéÉß@.<>&;/:\t\n   xyzw") + ["http://", "www.", "&amp;", "the "])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=1, max_size=40))
def test_preprocess_against_plain_python(spark, texts):
    texts = [unicodedata.normalize("NFC", t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", tx.preprocess("t").alias("p")).collect()}
    assert got == {i: plain_preprocess(t) for i, t in enumerate(texts)}
