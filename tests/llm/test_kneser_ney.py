"""The language model against the formulas in plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import kneser_ney as kn
from textmill.llm.queries import QUERIES

ROWS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "the cat ate the rat", "a rat sat", "The  CAT sat\ton the\nrug", "", None, "a a a a b b c",
     "on the mat the cat sat", "é à é à", "dogs sat on a dog", "x" * 300 + " tail", "   "] * 2)]


def words(text):
    return [w.decode(errors="replace") for w in (text or "").encode().lower().split()] + ["</s>"]


def give(counts):
    n = Counter(counts)
    if not all(n[i] for i in (1, 2, 3, 4)):
        return [0, 0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
    return [0, *[x if 0 < x < i else i / 2 for i, x in enumerate(d, 1)]]


def brute(train, texts):
    uni, pairs = Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    before = Counter(w for _, w in pairs)
    d2, d1 = give(pairs.values()), give(before.values())
    g = sum(d1[min(c, 3)] for c in before.values()) / len(pairs)

    def low(w):
        return (before[w] - d1[min(before[w], 3)]) / len(pairs) + g / (v + 1)

    out = []
    for t in texts:
        w = words(t)
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            after = {y: c for (x, y), c in pairs.items() if x == a}
            total = sum(after.values())
            back = sum(d2[min(c, 3)] for c in after.values()) / total if total else 1.0
            c = after.get(b, 0)
            score += math.log10(((c - d2[min(c, 3)]) / total if total else 0) + back * low(b))
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def test_equals_the_formulas(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = kn.KneserNey.fit(docs.filter("doc_id % 3 <> 0"))
    got = model.score(docs).orderBy("row.doc_id").collect()
    want = brute([t for i, t in ROWS if i % 3], [t for _, t in ROWS])
    for r, w in zip(got, want):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == pytest.approx(w[3:], rel=1e-6)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    model = kn.KneserNey.fit(docs)
    known = sorted({w for _, t in ROWS for w in words(t)[:-1]})
    for context in ("the", "cat", "unseen", "a"):
        texts = pa.array([f"{context} {w}" for w in known] + [f"{context} neverseen", context])
        p, *_, before = model.token_scores(texts)
        second = p[before[:-1] + 1]  # the word after the context; for the last text its end
        assert np.sum(10.0**second) == pytest.approx(1.0, abs=1e-6)


def test_nothing_to_learn_and_nothing_to_score(spark):
    docs = spark.createDataFrame(ROWS[:3], "doc_id long, text string")
    empty = docs.filter("doc_id < 0")
    r = kn.KneserNey.fit(empty).score(docs).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == 0.0
    assert kn.KneserNey.fit(docs).score(empty).count() == 0


def test_sums_survive_packing():
    rng = np.random.default_rng(1)
    keys, (counts,) = kn.added(rng.integers(0, 2**64, 1000, dtype=np.uint64), [np.arange(1000)])
    again, (c,) = kn.unpacked(kn.packed(keys, [counts]), 1)
    assert (again == keys).all() and (c == counts).all()


@pytest.mark.parametrize("bits", [1, 2, 7, 16, 33, 45, 63, 64])
def test_scrambling_is_one_to_one(bits):
    x = np.unique(np.random.default_rng(2).integers(0, 2**bits, 4000, dtype=np.uint64)) if bits > 12 else np.arange(1 << bits, dtype=np.uint64)
    y = kn.scramble(x, bits)
    assert len(np.unique(y)) == len(x) and int(y.max()) < 1 << bits and (kn.unscramble(y, bits) == x).all()


def test_merging_in_any_order():
    rng = np.random.default_rng(3)
    parts = [kn.added(rng.integers(0, 500, n).astype(np.uint64), [np.ones(n, np.int64), rng.integers(0, 9, n)]) for n in (900, 5, 60, 60, 1, 400)]
    m = kn.Merged(2)
    for k, c in parts:
        m.add(kn.packed(k, c))
    keys, columns = m.sums()
    want, sums = kn.added(np.concatenate([k for k, _ in parts]), [np.concatenate(c) for c in zip(*[c for _, c in parts])])
    assert (keys == want).all() and all((a == b).all() for a, b in zip(columns, sums))
    assert len(kn.Merged(2).sums()[0]) == 0


@pytest.mark.parametrize("many", [0, 10**9])
def test_keys_of_a_shard_in_blocks(tmp_path, monkeypatch, many):
    monkeypatch.setattr(kn, "_MANY", many)
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 2**40, 60_000), rng.integers(0, 2**33, 20_000)]).astype(np.uint64))
    counts = rng.integers(1, 400, len(keys))
    store, bounds = kn.Store(f"file://{tmp_path}"), kn.even_bounds(4, 2.0**40)
    files = []
    for s, part in enumerate(np.split(np.arange(len(keys)), np.searchsorted(keys, bounds[1:]))):
        batch = kn.sent(keys[part], [counts[part]], bounds)
        files += [b.to_pandas() for b in kn.keep_counts(store, bounds, 2.0**40)(iter([batch]))]
    assert all(f["blocks"][0] for f in files)
    found = kn.Counts(kn.pd.concat(files), bounds, store)
    asked = np.unique(np.concatenate([keys[::3], rng.integers(0, 2**40, 5000).astype(np.uint64)]))
    got, place = found.find(asked)
    want = dict(zip(keys.tolist(), counts.tolist()))
    assert got.tolist() == [want.get(k, 0) for k in asked.tolist()]
    there = got > 0
    assert (keys[place[there]] == asked[there]).all() and (found.keys_at(place[there]) == asked[there]).all()


def test_too_many_numbers_raise():
    with pytest.raises(OverflowError):
        kn.KneserNey._fits(65)


def test_high_counts_are_exact(spark):
    docs = spark.createDataFrame([(i, "again and again") for i in range(400)], "doc_id long, text string")
    r = kn.KneserNey.fit(docs).score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 4, 1600)
    assert r.score == pytest.approx(brute([t for _, t in docs.collect()], ["again and again"])[0][4], rel=1e-6)


def test_better_than_the_base_on_held_out_texts(spark, tables):
    rows = QUERIES["op5_kneser_ney"](spark, tables).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
