"""Repeated paragraphs, dated lists, and the pipeline's stages."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from textmill.llm import paragraphs, urls
from textmill.llm.queries import QUERIES
from textmill.llm.tables import read
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_lines import brute as dedup_lines
from tests.llm.test_minhash import brute as near


def passages():
    rng = random.Random(6)

    def passage(n):
        return [f"p{rng.randrange(4000)}" for _ in range(n)]

    shared, edited = [passage(60) for _ in range(3)], []
    for s in shared:
        t = list(s)
        t[rng.randrange(60)] = "changed"
        edited.append(t)
    rows = []
    for d in range(30):
        parts = [passage(rng.choice([5, 45, 80])) for _ in range(3)]
        if d % 3:
            parts.insert(rng.randrange(4), rng.choice([shared, edited])[d % 3])
        rows.append((d, "\n".join(" ".join(p) for p in parts)))
    own = " ".join(passage(50))
    return rows + [(100, own + "\n" + own), (101, None), (102, ""), (103, "short line\nshort line"), (None, rows[1][1])]


def brute_paragraphs(rows, min_words=40):
    paras = [(d, k, x.lower().split()) for d, t in rows if d is not None and t for k, x in enumerate(t.split("\n"))]
    paras = [(d, k, w) for d, k, w in paras if len(w) >= min_words]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for *_, w in paras]
    group = list(range(len(paras)))
    for i in range(len(paras)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for g in set(group):
        members = [(d, k, len(w)) for (d, k, w), x in zip(paras, group) if x == g]
        if len({d for d, *_ in members}) > 1:
            first = min(members)
            out += [(d, k, n, first[0], first[1], (d, k) != first[:2]) for d, k, n in members]
    return sorted(out)


def test_repeated_paragraphs_equal_brute_force(spark):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = paragraphs.repeated_paragraphs(docs)
    want = brute_paragraphs(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    assert sorted(map(tuple, paragraphs.repeated_paragraphs(docs, sent_bytes=0).collect())) == want
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(docs, got).filter("doc_id is not null").collect()}
    gone = {(d, k) for d, k, *_, out in want if out}
    for d, text in rows:
        if d is not None:
            assert left[d] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone))


def test_no_paragraphs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated_paragraphs(docs).count() == 0


def test_url_patterns(spark):
    cases = {"http://www.A.b.Example.org:80/x/y?z#q": ["a.b.example.org", "b.example.org", "example.org", "org",
                                                     "a.b.example.org/x", "a.b.example.org/x/y"],
             "https://user@host/": ["host"], "nonsense": [], None: [], "ftp://h.com//a//": ["h.com", "com", "h.com/a"]}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.url_patterns(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in rows} == cases


def test_lists_as_of_the_fetch(spark):
    entries = spark.createDataFrame([
        ("x.org", "add", 10), ("x.org", "remove", 20), ("x.org", "add", 30), ("x.org", "add", 35), ("a.x.org", "add", 15),
        ("x.org/p", "add", 0), ("x.org/p", "remove", 5), ("t.com", "remove", 7), ("t.com", "add", 7), (None, "add", 1),
        ("n.com", "add", None), ("o.com", "other", 1)], "pattern string, action string, at long")
    assert sorted(map(tuple, urls.validity_intervals(entries).collect()), key=str) == sorted(
        [("x.org", 10, 20), ("x.org", 30, None), ("a.x.org", 15, None), ("x.org/p", 0, 5), ("t.com", 7, None)], key=str)
    captures = spark.createDataFrame([
        (1, "http://x.org/", 9), (2, "http://x.org/", 10), (3, "http://x.org/", 20), (4, "http://a.x.org/", 16),
        (5, "http://x.org/p/q", 4), (6, "http://t.com", 7), (7, None, 7), (8, "http://x.org", None), (2, "http://x.org/", 10),
        (9, "http://n.com", 50)], "page_id long, url string, fetched_at long").withColumn("pattern", F.lit("clash"))
    got = {r.page_id: (r.n_rows, r.listed, r.n_patterns, r.pattern) for r in urls.listed_captures(captures, entries).collect()}
    assert got == {1: (1, False, 0, None), 2: (2, True, 1, "x.org"), 3: (1, False, 0, None), 4: (1, True, 2, "a.x.org"),
                   5: (1, True, 1, "x.org/p"), 6: (1, True, 1, "t.com"), 7: (1, False, 0, None), 8: (1, False, 0, None),
                   9: (1, False, 0, None)}
    assert urls.listed_captures(captures.filter("page_id > 99"), entries).count() == 0


def text_of(rows, kept_sha):
    return {d: x for (d, *_), x in zip(rows, kept_sha)}


def test_pipeline_stages_equal_plain_versions(spark, tables):
    docs = read(spark, tables, "documents")
    columns = docs.columns
    language = {r.doc_id: r for r in QUERIES["op3_crf_language"](spark, tables).collect()}
    one = corpus_pipeline.language(spark, docs, tables)
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {
        i for i, r in language.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    two = corpus_pipeline.line_dedup(spark, one, tables)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    import hashlib
    assert two.columns == columns
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in two.collect()} == {
        d: sha for d, _, _, sha in dedup_lines(rows)}
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = corpus_pipeline.near_dedup(spark, two, tables)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {i for i, (_, c) in near(rows).items() if i == c}
    four = corpus_pipeline.decontamination(spark, three, tables)
    rows = [(r.doc_id, r.text) for r in three.collect()]
    items = [(r.item_id, r.text) for r in read(spark, tables, "benchmark").collect()]
    assert four.columns == columns and {r.doc_id for r in four.collect()} == {r[0] for r in contaminated(rows, items) if not r[5]}
    five = corpus_pipeline.best_fit(spark, four, tables)
    want = {r.doc_id: len(r.text.encode().split()) + 1 for r in four.collect() if r.text.encode().split()}
    assert {r.doc_id: r.n for r in five.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    rows = [(None, "a b c", None, None, None, "x"), (1, None, "en", "s", 0, None), (2, "", None, "s", 0, None), (3, "d e f", None, None, 5, None)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} == {None, 3}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
