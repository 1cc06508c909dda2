"""Packing: nothing lost, nothing overfull, and the rules of the bins."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.llm.packing import opening, pack, pack_documents, token_count


def test_every_piece_once_and_no_bin_overfull():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    bins, offsets, lengths = pack(sizes, (40, 60, 100), 4)
    spans = sorted(zip(bins, offsets, sizes))
    for (b, o, s), (c, p, _) in zip(spans, spans[1:]):
        assert b != c or o + s == p
    for b, o, s in spans:
        assert o + s <= lengths[b]
    assert len(bins) == 500 and sum(lengths) < 1.05 * sum(sizes)


def test_best_fit_takes_the_tightest_bin():
    # 90 opens 100, 70 opens 100; 10 fits both and takes the first, then 30 fills the second.
    bins, _, lengths = pack([90, 70, 30, 10], (100,), 0)
    assert bins == [0, 1, 1, 0] and lengths == [100, 100]


def test_bins_shrink_to_their_contents():
    assert pack([60], (50, 64, 100), 0)[2] == [64]
    assert pack([10], (16, 1000), 5)[2] == [16]


def test_opening_weighs_cost_and_what_may_come():
    assert opening(10, 0, (16, 64), 0) == 16
    assert opening(10, 1000, (16, 64), 32) == 64


def test_brute_force_on_small_cases():
    """Never worse than twice the least total length."""
    rng = random.Random(5)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 12) for _ in range(6)), reverse=True)
        got = sum(pack(sizes, (4, 8, 12), 0)[2])

        def least(rest, rooms):
            if not rest:
                return sum(min(c for c in (4, 8, 12) if c >= u) for u in rooms)
            return min([least(rest[1:], [*rooms[:i], u + rest[0], *rooms[i + 1:]]) for i, u in enumerate(rooms) if u + rest[0] <= 12]
                       + [least(rest[1:], [*rooms, rest[0]])])

        assert got <= 2 * least(sizes, [])


def test_documents_are_cut_and_covered(spark):
    rows = [(1, " ".join(["w"] * 9000)), (2, "a b"), (3, None), (4, ""), (5, " \n "), (None, "x y z"), (2, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("clash"))
    got = pack_documents(docs, token_count(F.col("text"))).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == 9001
    assert sorted(r.piece for r in got if r.doc_id == 1) == [0, 1, 2]
    assert [r.n_tokens for r in got if r.doc_id == 2] == [3, 3] and [r.n_tokens for r in got if r.doc_id is None] == [4]
    assert {r.doc_id for r in got} == {1, 2, None}
    assert all(r.bin_used <= r.bin_capacity and r.bin_offset + r.n_tokens <= r.bin_used for r in got)


@pytest.mark.parametrize("shard_pieces", [7, 20_000])
def test_shards_and_empty_table(spark, shard_pieces):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("n"))
    got = pack_documents(docs, F.col("n"), shard_pieces=shard_pieces).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, i % 50 + 1) for i in range(200)]
    assert pack_documents(docs.filter("doc_id < 0"), F.col("n")).count() == 0
