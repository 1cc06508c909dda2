"""Near duplicates against brute force, and the parts of the search."""

import random

import numpy as np
import pytest

from textmill.llm import minhash
from textmill.llm.components import components
from textmill.llm.minhash import Banding


def brute(rows, threshold=75):
    """component_id of each row by comparing all pairs of word runs."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    best = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= threshold * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return {i: (len(s), best[i]) for i, s in sets}


def corpus(n=60):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(900)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 200]))]
        rows.append((i, " ".join(base)))
        i += 1
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("options", [{}, {"star_rounds": 0, "small": 2, "block": 8}])
def test_equals_brute_force(spark, options, monkeypatch):
    rows = corpus() + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "only three words"), (1004, "ONLY three  words")]
    if options:
        plain = minhash.near_links
        monkeypatch.setattr(minhash, "near_links", lambda *a, **k: plain(*a, **k, **options))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_clashing_columns_null_ids_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", None), (None, "g h i j k", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("key", docs_lit())
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True)], key=str)


def docs_lit():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group_of_copies_and_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 420):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.select("component_id").distinct().collect()} == {0}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (700, 700)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500, 700: 700}


def test_densification_copies_full_bins_alike():
    rng = np.random.default_rng(1)
    few = np.sort(rng.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2))
    sig = minhash.signature(few, 128)
    assert set(sig) <= set(few) and len(set(sig)) > 1
    assert (minhash.signature(few, 128) == sig).all()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a, 1024) == minhash.signature(b, 1024)).mean() - true) < 0.06


def test_tuned_banding_reaches_the_recall():
    b = Banding.tuned(75, 0.999, 48, 512)
    assert b.recall(0.75) >= 0.999 and b.bins <= 48
    assert Banding(48 // (b.rows + 1) * (b.rows + 1), b.rows + 1).recall(0.75) < 0.999


def test_links_are_never_ruled_out():
    rng = np.random.default_rng(4)
    banding = Banding()
    for size in (10, 100, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 2**64, size // 20, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = (minhash.sketches(np.stack([minhash.signature(s, 128)]), [s], banding).view(np.uint64)[0] for s in (a, b))
                assert minhash.may_link(75, banding, np.int64(len(a)), x, np.int64(len(b)), y)


@pytest.mark.parametrize("banding", [Banding(), Banding.tuned(75, 0.999, 48, 512)])
@pytest.mark.parametrize("both,every", [(3, 4), (6, 8), (9, 12)])
def test_links_of_short_sets_are_never_ruled_out(banding, both, every):
    rng = np.random.default_rng(8)
    for _ in range(3000):
        b = np.unique(rng.integers(0, 2**64, every, dtype=np.uint64))
        a = np.sort(rng.permutation(b)[:both])
        x, y = (minhash.sketches(np.stack([minhash.signature(s, banding.bins)]), [s], banding).view(np.uint64)[0] for s in (a, b))
        assert minhash.may_link(75, banding, np.int64(both), x, np.int64(every), y)
