"""The model of triples against the formulas in plain Python."""

import math
from collections import Counter, defaultdict

import pytest

from textmill.llm import kneser_ney as kn
from tests.llm.test_kneser_ney import ROWS, give, words


def brute(train, texts):
    triples = Counter()
    for t in train:
        w = ["<s>", "<s>", *words(t)]
        triples.update(zip(w, w[1:], w[2:]))
    pairs = Counter()  # different words before; at the beginning of a text, how often
    for (a, b, c), n in triples.items():
        pairs[b, c] += n if b == "<s>" else 1
    uni = Counter(w for _, w in pairs)
    d3, d2, d1 = give(triples.values()), give(pairs.values()), give(uni.values())

    def part(counts, d):
        after = defaultdict(list)
        for k, c in counts.items():
            after[k[:-1]].append(c)

        def share(k, lower):
            c, all_ = counts[k], after.get(k[:-1])
            if not all_:
                return lower
            return (c - d[min(c, 3)]) / sum(all_) + sum(d[min(x, 3)] for x in all_) / sum(all_) * lower
        return share

    three, two, out = part(triples, d3), part(pairs, d2), []
    g = sum(d1[min(c, 3)] for c in uni.values()) / len(pairs)
    for t in texts:
        w, score = ["<s>", "<s>", *words(t)], 0.0
        for k in zip(w, w[1:], w[2:]):
            low = (uni[k[2]] - d1[min(uni[k[2]], 3)]) / len(pairs) + g / (len(uni) + 1)
            score += math.log10(three(k, two(k[1:], low)))
        out.append(score)
    return out


def test_triples_equal_the_formulas(spark):
    more = [(100 + i, " ".join("xyzuvw"[(i * k * k + k) % 6] for k in range(i))) for i in range(30)]
    docs = spark.createDataFrame(ROWS + more, "doc_id long, text string")
    got = kn.KneserNey.fit(docs.filter("doc_id % 3 <> 0"), order=3).score(docs).orderBy("row.doc_id").collect()
    want = brute([t for i, t in ROWS + more if i % 3], [t for _, t in ROWS + more])
    assert [r.score for r in got] == pytest.approx(want, rel=1e-6)


def test_longer_contexts_tell_texts_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "x b d"] * 5)], "doc_id long, text string")
    probe = spark.createDataFrame([(0, "a b c"), (1, "a b d")], "doc_id long, text string")
    right, wrong = (r.score for r in kn.KneserNey.fit(docs, order=3).score(probe).orderBy("row.doc_id").collect())
    assert right > wrong + 0.1
    empty = kn.KneserNey.fit(docs.filter("doc_id < 0"), order=3).score(probe).first()
    assert empty.train_tokens == 0 and math.isfinite(empty.score)
