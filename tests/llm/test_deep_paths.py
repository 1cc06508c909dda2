"""Entries of any depth of path match."""

from textmill.llm import urls


def test_entries_with_deep_paths_match(spark):
    deep = "x.org/" + "/".join("abcdefghijklm")
    entries = spark.createDataFrame([("x.org/a/b/c/d/e/f/g/h/i", "add", 1), (deep, "add", 5)], "pattern string, action string, at long")
    captures = spark.createDataFrame([
        (1, f"http://{deep}/n?q", 6), (2, f"http://{deep}", 2), (3, "http://x.org/a/b/c/d/e/f/g/h", 6)],
        "page_id long, url string, fetched_at long")
    got = {r.page_id: (r.listed, r.n_patterns, r.pattern) for r in urls.listed_captures(captures, entries).collect()}
    assert got == {1: (True, 2, deep), 2: (True, 1, "x.org/a/b/c/d/e/f/g/h/i"), 3: (False, 0, None)}
