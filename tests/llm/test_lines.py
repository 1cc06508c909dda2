"""Line dedup against plain Python, and the filters."""

import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import pytest

from textmill.llm import lines, queries
from textmill.llm.lines import CuckooFilter, LineIndex

WS = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(WS))


def brute(rows, min_docs=5):
    held = defaultdict(list)
    for r, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(i)
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        kept = []
        for x in split:
            ids = held.get(key(x), [])
            last = max((j for j in ids if j is not None), default=None)
            n_docs = len({j for j in ids if j is not None}) + sum(j is None for j in ids)
            if n_docs < min_docs or last is None or i == last:
                kept.append(x)
        out.append((i, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(2)
    common = [f"This line number {k} is shared by many of the documents here" for k in range(12)]
    common += ["é" * 40, "é" * 39, "x" * 40, "y" * 39]
    rows = []
    for i in range(80):
        own = [f"only document {i} has this line, and it is long enough {rng.random()}" for _ in range(3)]
        body = own + [rng.choice(["  ", "\t", ""]) + (c.upper() if rng.random() < 0.3 and c.isascii() else c) + rng.choice(["", " \r"])
                      for c in common if rng.random() < 0.2]
        rng.shuffle(body)
        rows.append((i, "\n".join(body + body[:1])))
    return rows + [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(common)), (None, common[0])]


@pytest.mark.parametrize("sent_bytes", [32 << 20, 0])
def test_equals_plain_python(spark, sent_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.build(docs)
    index = LineIndex(index.counts, index.refs, index.filters, index.shards, sent_bytes=sent_bytes)
    got = index.apply(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_null_text_stays_null_and_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, None, "a", 2)], "doc_id long, text string, kept_text string, n_lines int")
    r = LineIndex.build(docs).apply(docs).first()
    assert r.kept_text is None and r.n_lines == 1 and r.row.kept_text == "a" and r.row.n_lines == 2


def test_rows_of_one_id_are_one_document(spark):
    line = "a line that is long enough to be counted as one of these"
    rows = [(1, line), (2, line), (3, line), (3, line + "\n" + line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in LineIndex.build(docs).apply(docs).collect()} == {0}
    more = rows + [(4, line), (5, line), (5, line)]
    docs = spark.createDataFrame(more, "doc_id long, text string")
    for sent in (32 << 20, 0):
        got = replace(LineIndex.build(docs), sent_bytes=sent).apply(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(brute(more))
        assert {r.doc_id for r in got if r.n_dropped == 0} == {5}


def test_query_with_repeated_rows_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows + rows[::3] + [(i % 7, t) for i, t in rows[::5]], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    # The statement joins the rows of an id, so texts of ids that have several are compared by their lines that went.
    gone = lambda rows: sorted((i, n) for i, n in rows)
    want = con.execute(f"select doc_id, sum(n_dropped)::int from ({queries.SQL['op10_reversible_line_dedup']}) group by 1").fetchall()
    got = queries.QUERIES["op10_reversible_line_dedup"](spark, str(tmp_path)).groupBy("doc_id").sum("n_dropped").collect()
    assert gone(map(tuple, got)) == gone(want)


def test_nothing_is_added_without_holders(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    index = LineIndex.build(docs, keep_refs=False)
    for change in (index.add, index.remove):
        with pytest.raises(ValueError, match="keep_refs"):
            change(docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert LineIndex.build(docs).apply(docs).count() == 0


def rows_of(index):
    return sorted((bytes(r.digest), r.n_docs, r.last_doc) for r in index.counts.collect())


def test_insertions_and_deletions_reverse(spark):
    rows = [r for r in corpus() if r[0] is not None]
    one, two = spark.createDataFrame(rows[:50], "doc_id long, text string"), spark.createDataFrame(rows[50:], "doc_id long, text string")
    both = LineIndex.build(one.union(two))
    first = LineIndex.build(one)
    grown = first.add(two)
    assert rows_of(grown) == rows_of(both)
    back = grown.remove(two.select("doc_id")).compacted()
    assert rows_of(back) == rows_of(first)
    for index in (grown, back):
        filters = {r.shard: CuckooFilter.of(bytes(r.slots)) for r in index.filters.collect()}
        assert all(bytes(r.digest) in filters[0] for r in index.counts.filter("n_docs >= 5").collect())
    want = [tuple(r)[1:] for r in first.apply(one).orderBy("row.doc_id").collect()]
    assert [tuple(r)[1:] for r in back.apply(one).orderBy("row.doc_id").collect()] == want


def test_cuckoo_filter_holds_forgets_and_rarely_errs():
    rng = random.Random(1)
    inside, outside = ([rng.randbytes(16) for _ in range(3000)] for _ in range(2))
    f = CuckooFilter.build(inside)
    assert all(d in f for d in inside) and sum(d in f for d in outside) < 10
    for d in inside[:1500]:
        f.remove(d)
    assert all(d in f for d in inside[1500:]) and sum(d in f for d in inside[:1500]) < 10


def test_vector_lookup_equals_the_filter():
    import numpy as np
    rng = random.Random(4)
    some = [rng.randbytes(16) for _ in range(500)] + [b"\0\0" + rng.randbytes(14) for _ in range(5)]
    f = CuckooFilter.build(some[::2])
    flat = np.frombuffer(b"".join(some), np.uint8).reshape(-1, 16)
    assert lines.matches({0: f.slots}, 1, flat).tolist() == [d in f for d in some]
