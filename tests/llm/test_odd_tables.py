"""Tables that real corpora hold and small samples do not."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import minhash, packing
from textmill.llm.queries import QUERIES
from textmill.llm.sampling import joined_sample, labelled_sample


def test_a_thousand_labels(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 1000).alias("lang"))
    assert labelled_sample(rows, "lang", 2, 100, None)["lang"].nunique() > 800
    assert set(labelled_sample(rows.withColumn("lang", F.when(F.col("doc_id") < 3000, "a").otherwise("b")), "lang", 10, 100, 1)["lang"]) == {"a"}


def test_a_label_of_long_texts_only_is_learned(spark):
    rows = spark.createDataFrame([(1, "x" * 50, "a"), (2, "y" * 9, "b"), (3, "z" * 50, "b"), (None, "q", "c"), (4, None, "d"), (5, "v", None)],
                                 "doc_id long, text string, lang string")
    got = labelled_sample(rows, "lang", 300, 10, None)
    assert sorted(zip(got["lang"], got["text"])) == [("a", "x" * 10), ("b", "y" * 9), ("c", "q")]


def test_of_two_labels_of_an_id_the_smaller_counts(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    got = joined_sample(docs, labels, "toxic", 10, 100, 2)
    assert sorted(zip(got["doc_id"], got["toxic"])) == [(1, 0), (2, 1)]


def test_pieces_without_id_are_dealt_evenly(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5000).alias("n"))
    got = packing.pack_documents(docs, F.col("n"), shard_pieces=100).collect()
    assert len(got) == 800
    dealt = Counter(r["shard"] for r in got)
    assert len(dealt) == 9 and max(dealt.values()) < 160
    used = Counter()
    for r in got:
        used[r["shard"], r["bin"]] += r["n_tokens"]
        assert r["doc_id"] is None and r["bin_used"] <= r["bin_capacity"]
    assert all(used[r["shard"], r["bin"]] == r["bin_used"] for r in got)


def test_some_captures_are_listed_by_a_path(spark, tables):
    got = QUERIES["op4_temporal_url_lists"](spark, tables).filter("listed").collect()
    assert {r["pattern"].count("/") for r in got} >= {0, 1, 2}


def test_an_id_with_two_texts_links_both(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    for rows, want in (
            ([(1, x + " x"), (2, y + " y"), (7, x), (7, y)], {1: 1, 2: 1, 7: 1}),
            ([(7, x), (7, y), (9, y), (8, "other words here and there"), (3, x + " z"), (None, x)], {7: 3, 9: 3, 8: 8, 3: 3, None: 3}),
            ([(5, x), (5, y), (6, "")], {5: 5, 6: 6})):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == want


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_one_row_of_each_group(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, x), (None, x), (None, x + " end"), (3, y), (3, y), (4, y), (None, None), (5, ""), (None, "b c d"), (6, "b c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got if r.text and r.text[0] != "a") == [(3, y), (6, "b c d")]
    assert sum(bool(r.text) and r.text[0] == "a" for r in got) in (1, 2)  # without ids, near copies are not linked
    assert sum(not r.text for r in got) == 2


def test_pipeline_decontaminates_rows_without_id(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, item, "en", "s", 0), (None, "clean " * 9, "en", "s", 0), (1, item + " x", "en", "s", 0), (1, "fine", "en", "s", 0)], DOCS)
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["clean " * 9, "fine"]
