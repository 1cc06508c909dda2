"""Filter audit against playing every order."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from textmill.llm.filter_audit import FILTERS, failed_filters, filter_orders, lehmer_rank, removal_intervals

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def test_ranks_are_those_of_sorted_orders():
    for rank, order in enumerate(permutations(range(4))):
        assert lehmer_rank(order, 4) == rank


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_intervals_cover_each_removal_once(n):
    played = Counter()
    for rank, order in enumerate(permutations(range(n))):
        for mask in range(1, 1 << n):
            played[mask, 1 + next(k for k, f in enumerate(order) if mask >> f & 1), rank] += 1
    told = Counter((mask, step, rank) for mask, step, a, b in removal_intervals(n) for rank in range(a, b))
    assert told == played


def played_out(rows):
    """(part, order, step) to the counts, by applying every order to every row."""
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations(FILTERS)):
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << FILTERS.index(letter)
                gone = [r for r in left if r[1] & bit]
                left = [r for r in left if not r[1] & bit]
                shares[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(bool(r[1] & bit) for r in own) - len(gone),
                                          sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_counts_are_those_of_every_order_played(spark):
    rows = [("a", 0, 1, 0), ("a", 3, 1, 1), ("a", 16, 0, 1), ("a", 31, 1, 0), ("", 5, 0, 0), ("", 5, 1, 0), ("", 8, 0, 1),
            ("b", 0, 0, 0)] * 2
    got = filter_orders(spark.createDataFrame(rows, "part string, mask int, good int, toxic int")).collect()
    assert len(got) == 3 * 120 * 5
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == played_out(rows)


def test_filters_of_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, clean, "s"), (2, clean, None), (2, clean, "s"), (None, clean, "s"), (3, None, "s"), (4, "", "s"), (5, "$ x x x", "s"),
         (6, clean.upper() + " ", "s"), (7, "a b " * 40, "s"), (8, "x y " * 60_000, "s")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, None, 1), (None, 1, 1), (99, 1, 1)], LABELS)
    got = sorted(map(tuple, failed_filters(docs, labels).collect()))
    assert got == sorted([
        ("s", 0, 1, 1), ("", 16, 0, 0), ("s", 16, 0, 0), ("s", 0, 0, 0), ("s", 1, 0, 0), ("s", 17, 0, 0), ("s", 11, 0, 1),
        ("s", 4, 0, 0), ("s", 3, 0, 0), ("s", 2, 0, 0)])


def test_empty_table_and_clashing_names(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([], DOCS)
    assert filter_orders(failed_filters(docs, labels)).count() == 0
    clash = spark.createDataFrame([(1, "x", "s")], DOCS)
    names = ("words", "n", "mask", "digest", "first", "part", "good", "toxic", "quality", "rank", "step")
    wide = clash.select("*", *[F.lit(7).alias(c) for c in names])
    got = filter_orders(failed_filters(wide, labels.withColumn("mask", F.lit(1)))).collect()
    assert len(got) == 600 and {r.kept for r in got if r.step == 5} == {0}
