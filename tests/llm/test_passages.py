"""Repeated passages against all runs of words in plain Python."""

import random
from collections import defaultdict

from textmill.llm import paragraphs


def brute(rows, length=50):
    """(doc_id, words covered that stay elsewhere) and (doc_id, words covered that stay here)."""
    where = defaultdict(list)
    for d, t in rows:
        w = (t or "").lower().split()
        for i in range(len(w) - length + 1) if d is not None else ():
            where[tuple(w[i:i + length])].append((d, i))
    out = defaultdict(set)
    for at in where.values():
        if len({d for d, _ in at}) > 1:
            for d, i in at:
                out[d, min(at)[0], (d, i) != min(at)] |= set(range(i, i + length))
    return dict(out)


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id, r.keeper_doc_id, r.removed] |= set(range(r.start, r.start + r.n_words))
    return dict(out)


def test_passages_over_lines_and_inside_a_line(spark):
    rng = random.Random(11)

    def words(n):
        return [f"p{rng.randrange(4000)}" for _ in range(n)]

    over, inside, short = words(60), words(60), words(49)
    lines = [" ".join(over[k:k + 20]) for k in (0, 20, 40)]
    rows = [(1, "\n".join([" ".join(words(7)), *lines])),
            (2, "\n".join([*lines, " ".join(words(9))])),
            (3, " ".join(words(45) + inside + words(45))), (4, "x\n" + " ".join(words(30) + inside + words(60))),
            (5, " ".join(words(9) + short)), (6, " ".join(short + words(9))), (7, None), (8, ""), (None, lines[0])]
    got = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 60, 1, 1, False, 7, 7), (2, 0, 60, 1, 1, True, 0, 7),
                                       (3, 0, 60, 3, 0, False, 45, 45), (4, 1, 60, 3, 0, True, 31, 45)]


def test_passages_equal_brute_force(spark):
    rng = random.Random(12)
    pool = [f"p{rng.randrange(500)}" for _ in range(900)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(4):
            a = rng.randrange(800)
            text += pool[a:a + rng.choice([20, 49, 50, 51, 90])] + [f"own{d}"] * rng.choice([1, 70])
        rows.append((d, "".join(w + rng.choice([" ", "\n"]) for w in text)))
    rows += [(50, "a " * 120), (51, "a " * 60), (51, "a " * 60)]
    got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert covered(got) == want and len(want) > 20


def test_passages_are_cut_out_of_their_lines(spark):
    passage = [f"p{i}" for i in range(60)]
    first = "begin here " + " ".join(passage[:30]) + "\n" + " ".join(passage[30:]) + " and end"
    second = "own words stand before " + " ".join(passage[:25]) + "\n" + " ".join(passage[25:]) + " own words behind\nlast line"
    docs = spark.createDataFrame([(1, first, 7), (2, second, 8), (3, None, 9), (None, second, 9), (4, "", 1)], "doc_id long, text string, n long")
    left = paragraphs.without_repeats(docs, paragraphs.repeated_passages(docs)
                                      .select("doc_id", "para", "n_words", "removed", "start"))
    assert left.columns == docs.columns
    got = {r.doc_id: (r.text, r.n) for r in left.collect()}
    assert got == {1: (first, 7), 2: ("own words stand before  own words behind\nlast line", 8), 3: (None, 9), None: (second, 9), 4: ("", 1)}


def test_cuts_of_lines_and_ranges():
    raw = b"a b c\nd e\nf\n g h"
    assert paragraphs._cut(raw, {1}, []) == b"a b c\nf\n g h"
    assert paragraphs._cut(raw, {2, 3}, []) == b"a b c\nd e"
    assert paragraphs._cut(raw, {0, 1, 2, 3}, []) == b""
    assert paragraphs._cut(raw, set(), [(1, 4)]) == b"a  e\nf\n g h"
    assert paragraphs._cut(raw, {0}, [(5, 7)]) == b"d e\n h"
