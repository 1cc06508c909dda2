import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import augment as aug
from textmill.operators import clean, dedup, evaluate, neardup, quality, split, stats

TEXTS = "id long, text string, label string"


def corpus(spark, rows, parts=3):
    return spark.createDataFrame(rows, TEXTS).repartition(parts)


def test_keep_first_and_idempotence(spark):
    df = corpus(spark, [(3, "b", "x"), (1, "a", "x"), (2, "a", "y"), (4, None, "z"), (5, None, "z")])
    once = dedup.drop_exact_duplicates(df, "text", ["id"])
    assert sorted(r["id"] for r in once.collect()) == [1, 3, 4]
    twice = dedup.drop_exact_duplicates(once, "text", ["id"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_group_limit_runs_before_the_shuffle(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = dedup.drop_exact_duplicates(docs, "text", ["doc_id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_links_describe_every_pair(spark):
    rows = [(i, t, "x") for i, t in enumerate(["a b", "A  b ", "c", "a B", "c", "d"])]
    df = corpus(spark, rows)
    links = {(r["left_id"], r["right_id"]) for r in dedup.duplicate_links(df, "id", "text").collect()}
    assert links == {(0, 1), (0, 3), (2, 4)}
    groups = {r["first_id"]: r["n_pairs"] for r in dedup.duplicate_groups(df, "id", "text").collect()}
    assert groups == {0: 3, 2: 1}


def brute_near(rows, t):
    def grams(text):
        n = " ".join(text.lower().split())
        return frozenset([n] if len(n) < 3 else (n[i:i + 3] for i in range(len(n) - 2)))

    firsts, out = {}, set()
    for i, text in rows:
        g = grams(text)
        if g in firsts:
            out.add((firsts[g], i, 1.0))
        else:
            firsts[g] = i
    items = sorted((i, g) for g, i in firsts.items())
    for a, (i, x) in enumerate(items):
        for j, y in items[a + 1:]:
            s = len(x & y) / len(x | y)
            if s >= t:
                out.add((i, j, round(s, 9)))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_near_duplicates_equal_brute_force(spark, tables, threshold):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{tables}/documents.parquet")
            .select("doc_id", "text").collect()]
    n = len(rows)
    # Small edits, short texts and one text that fills a third of the rows.
    rows += [(1000 + i, t[: max(3, len(t) * 97 // 100)]) for i, t in rows[:60]]
    rows += [(2000 + i, t) for i, t in enumerate(["", "a", "ab", "abc", "abcd", "abcde", "bcde", "abc ", "xyz"])]
    rows += [(3000 + i, "the same text again and again") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r[0], r[1], round(r[2], 9)) for r in neardup.near_duplicates(df, "id", "text", threshold).collect()}
    assert got == brute_near(rows, threshold)


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
@pytest.mark.parametrize("n, differing", [(3, 1), (40, 6), (300, 33), (300, 70)])
def test_covering_signatures_agree_in_enough_parts(radius, n, differing):
    rng = random.Random(n + radius)
    for _ in range(40):
        grams = rng.sample(range(10_000), n + differing)
        cut = rng.randint(0, differing)
        a, b = np.array(grams[:n + cut]), np.array(grams[:n] + grams[n + cut:])
        keys_a, part = neardup.covering(np.sort(a), 5, differing, radius)
        keys_b, _ = neardup.covering(np.sort(b), 5, differing, radius)
        assert len(set(part[keys_a == keys_b])) >= 1 + neardup._SLACK


def test_a_larger_radius_gives_the_same_pairs_from_fewer_candidates(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    distinct = neardup.distinct_sets(neardup.gram_sets(df, "doc_id", "text"))
    pairs = {r: neardup.candidate_pairs(neardup.signatures(distinct, 0.8, r), 0.8).count() for r in (0, 3)}
    assert pairs[3] < pairs[0]
    got = [set(map(tuple, neardup.near_duplicates(df, "doc_id", "text", 0.8, r).collect())) for r in (0, 3)]
    assert got[0] == got[1]


def test_sets_with_many_empty_parts_still_meet(spark):
    base = ["ab" * 50, "ab" * 50 + "c", "ab" * 60, "aaaa", "aaaaa", "aaaaab"]
    rows = list(enumerate(base))
    df = spark.createDataFrame(rows, "id long, text string")
    for t in (0.3, 0.6, 0.9):
        got = {(r[0], r[1], round(r[2], 9)) for r in neardup.near_duplicates(df, "id", "text", t).collect()}
        assert got == brute_near(rows, t)


def test_quality_of_a_small_corpus(spark):
    rows = [(1, "Same text", "A"), (2, "same  text", "B"), (3, "other", "A"), (4, "  ", "A"), (5, "x" * 150, "A")]
    r = quality.quality_report(corpus(spark, rows), "id", "text", "label").first()
    assert (r["total_rows"], r["unique_texts"], r["duplicate_texts"]) == (5, 4, 1)
    assert (r["label_conflicts"], r["exact_duplicate_pairs"]) == (1, 1)
    assert (r["short_texts"], r["empty_texts"], r["max_length"]) == (4, 1, 150)
    assert r["imbalance_ratio"] == 4.0
    # 20 for duplicates, 10 for the conflict, 10 for short texts
    assert (r["quality_score"], r["verdict"]) == (60, "needs attention")
    c = quality.label_conflicts(corpus(spark, rows), "id", "text", "label").first()
    assert (c["first_id"], c["labels"], c["sample"], c["n"]) == (1, ["A", "B"], "Same text", 2)


def test_quality_of_an_empty_corpus(spark):
    r = quality.quality_report(spark.createDataFrame([], TEXTS), "id", "text", "label").first()
    assert r["total_rows"] == 0 and r["avg_length"] == 0 and math.isinf(r["imbalance_ratio"])


def test_status(spark):
    m = quality.quality_metrics(corpus(spark, [(i, "t" * 120 + str(i), "A") for i in range(20)]), "id", "text", "label")
    assert quality.with_quality_status(m).first()["status"] == "Good"


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        clean.require_columns(spark.range(1), ["text"], "corpus")


def test_clean_corpus(spark):
    rows = [(i, f"text {i}", "HR") for i in range(20)] + [(20 + i, f"text {i}", "hr") for i in range(5)]
    rows += [(100, "Python developer, SQL", "AUTOMOBILE"), (101, "rare one", "Chef")]
    c = clean.clean_corpus(corpus(spark, rows), "id", "text", "label")
    assert sorted(r["id"] for r in c.kept.collect()) == list(range(20))
    assert {(r["row_id"], r["label"], r["reason"]) for r in c.audit.collect()} == {
        (100, "AUTOMOBILE", "mislabeled, suggested: Information-Technology"), (101, "Chef", "tiny category")}
    s = c.stats.first()
    assert tuple(s) == (27, 1, 1, 5, 20, 4, 1)
    assert c.unknown.count() == 0


def test_split_is_exact_and_independent_of_partitions(spark):
    rows = [(i, "t", "AB"[i % 3 == 0]) for i in range(103)]
    a = split.train_test_split(corpus(spark, rows, 1), "id", "label")
    b = split.train_test_split(corpus(spark, rows, 7), "id", "label")
    assert sorted(a.collect()) == sorted(b.collect())
    tested = a.filter("is_test")
    assert tested.count() == math.ceil(103 * 0.2) and a.count() == 103
    shares = {r["label"]: r["n"] for r in stats.label_counts(tested, "label").collect()}
    assert shares == {"A": 14, "B": 7}


def test_rank_counts_through_each_label(spark):
    rows = [(i, "t", "AB"[i % 5 == 0]) for i in range(200)]
    ranked = split.stratified_rank(corpus(spark, rows), "id", "label", bucket_digits=1).collect()
    for name, n in (("A", 160), ("B", 40)):
        assert sorted(r["label_rank"] for r in ranked if r["label"] == name) == list(range(1, n + 1))
    folds = split.stratified_folds(corpus(spark, rows), "id", "label", 4)
    assert {r["n"] for r in folds.groupBy("fold", "label").agg(F.count("*").alias("n")).filter("label = 'B'").collect()} == {10}


def test_evaluation(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "c")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    c = evaluate.confusion_counts(df, "label", "prediction")
    o = evaluate.overall_metrics(c).first()
    assert o["accuracy"] == pytest.approx(5 / 7)
    assert o["precision_macro"] == pytest.approx((1 + 2 / 3 + 0) / 3)
    assert o["recall_weighted"] == pytest.approx(5 / 7)
    dense = evaluate.normalized_confusion(evaluate.confusion_matrix(c)).collect()
    assert len(dense) == 9
    assert all(r["share"] is None for r in dense if r["label"] == "c")


WORDS = " ".join(f"w{i}" for i in range(40))


def test_augmentation_operations(spark):
    df = spark.createDataFrame([(1, WORDS), (2, "a b"), (3, "")], "id long, t string")
    salt = [42, F.col("id")]

    def run(c):
        return {r["id"]: r["r"].split() for r in df.select("id", c.alias("r")).collect()}

    words = WORDS.split()
    shuffled = run(aug.shuffle_tokens("t", salt))
    assert sorted(shuffled[1]) == sorted(words) and shuffled[1] != words and shuffled[2] == ["a", "b"]
    assert sum(a != b for a, b in zip(shuffled[1], words)) <= 12
    deleted = run(aug.delete_tokens("t", salt))
    assert len(deleted[1]) == 36 and [w for w in words if w in deleted[1]] == deleted[1]
    doubled = run(aug.duplicate_tokens("t", salt))
    assert len(doubled[1]) == 44 and sorted(set(doubled[1])) == sorted(words)
    swapped = run(aug.swap_tokens("t", salt))
    assert sorted(swapped[1]) == sorted(words) and swapped[1] != words and swapped[2] == ["b", "a"]


def test_augmented_copies_do_not_depend_on_partitions(spark):
    rows = [(i, WORDS, "x") for i in range(30)]
    a = aug.augment_dataset(corpus(spark, rows, 1), "id", "text")
    b = aug.augment_dataset(corpus(spark, rows, 6), "id", "text")
    assert sorted(a.collect()) == sorted(b.collect())
    copies = a.filter("copy_no > 0")
    assert 30 < a.count() <= 90 and copies.filter(F.col("text") == WORDS).count() == 0


def test_copies_are_made_by_the_operations(spark):
    texts = [WORDS, "a b", " a\tb  c d\x0be ", "", None, "x", "\u00e9\u00a0f g h i", "one two three\n four five six seven"]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts * 3)], "id long, t string")
    one = {"shuffle": lambda s: aug.shuffle_tokens("t", s, 0.2), "delete": lambda s: aug.delete_tokens("t", s, 0.05),
           "duplicate": lambda s: aug.duplicate_tokens("t", s, 0.05), "swap": lambda s: aug.swap_tokens("t", s, 2)}
    for name, make in one.items():
        made = df.select(aug.augmented_text("t", "id", F.lit(1), [name]).alias("a"), make([42, F.col("id"), F.lit(1), 0]).alias("b"))
        assert all(r["a"] == r["b"] for r in made.collect())
    # Several steps on one text are not one nest of array expressions.
    plan = aug.augment(df, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan


def test_distribution_table(spark):
    rows = [(i, "t", f"l{i % 7}") for i in range(70)] + [(99, "t", "l0")]
    t = stats.distribution_table(corpus(spark, rows), "label", max_items=3).collect()
    assert [(r["label"], r["n"], r["bar_length"], r["n_more"]) for r in t] == [
        ("l0", 11, 30, 4), ("l1", 10, 27, 4), ("l2", 10, 27, 4)]
