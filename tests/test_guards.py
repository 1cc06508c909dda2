"""Cleaning steps pass over texts without their signs, with the results of the bare patterns."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as tx

TEXTS = ["plain words", "a <b>bold</b> c", "a < b", "x &lt;i&gt; &amp;nbsp; y", "see http://a.b/c d", "see https://e f", "www.g.h i",
         "www. j", "http:/k", "l://m", "n@o.p q", "@r.s", "", None, "&amp;lt;t&gt;"]


@pytest.mark.parametrize("step, pattern", [
    (tx.clean_html, "<[^>]+>"), (tx.remove_urls, rf"https?://{tx.NON_SPACE}+|www\.{tx.NON_SPACE}+")])
def test_guarded_steps_equal_the_patterns(spark, step, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    bare = F.regexp_replace("t", pattern, " ")
    if step is tx.clean_html:
        bare = tx._decoded(bare)
    rows = df.select(step("t").alias("a"), bare.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_patterns_run_only_where_their_sign_is(spark):
    plan = spark.range(1).select(tx.clean_html(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "contains" in plan.lower()
