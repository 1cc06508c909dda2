"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import (
    alignment, decontaminate, filter_audit, kneser_ney, langid, lines, minhash, packing, paragraphs, quality, substrings,
    toxicity, urls)
from textmill.llm.tables import read
from textmill.llm.words import held_out, space_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_distribution_divergence(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return quality.judge(docs, quality.language_references(docs))


@register
def op2_repeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.repeats(read(spark, d, "documents"))


@register
def op3_crf_language(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    test = held_out(F.col("doc_id"), 3, 1)
    tagger = langid.fit_languages(docs.filter(~test))
    return langid.identify(docs.select("doc_id", "text"), tagger).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def _drawn(*parts: Column | str) -> Column:
    """A number below 2**32 that the parts decide, as SQL can restate it."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


@register
def op4_temporal_url_lists(spark: SparkSession, d: str) -> DataFrame:
    """Captures are the pages, fetched at a second of a year that their id decides.  The
    list follows from their URLs: half of the hosts are added and removed three times, half of
    the parent domains are added once, and so is a quarter of the beginnings of paths, of
    each page one of any depth."""
    year = 365 * 86400
    pages = read(spark, d, "pages").select("page_id", "url").withColumn(
        "fetched_at", F.pmod(_drawn("fetched", F.col("page_id").cast("string")), F.lit(year)))
    hosts = pages.select(urls.url_host(F.col("url")).alias("pattern")).filter("pattern is not null").distinct()
    cycles = hosts.filter(_drawn("host", F.col("pattern")) % 2 == 0).select(
        "pattern", F.explode(F.array(*[F.lit(str(k)) for k in range(3)])).alias("k"))
    begun = cycles.withColumn("at", _drawn("add", F.col("pattern"), F.col("k")) % year)
    ended = begun.withColumn("at", F.col("at") + 86400 * (20 + _drawn("remove", F.col("pattern"), F.col("k")) % 60))
    parents = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct().filter(
        _drawn("parent", F.col("pattern")) % 2 == 0)
    parts = F.array_remove(F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), "/"), "")
    paths = pages.select(urls.url_host(F.col("url")).alias("host"), parts.alias("parts"), "url").filter(
        (F.col("host").isNotNull()) & (F.size("parts") > 0)).select(F.concat_ws("/", "host", F.array_join(F.slice(
            "parts", F.lit(1), (1 + _drawn("depth", F.col("url")) % F.size("parts")).cast("int")), "/")).alias("pattern")).distinct().filter(
        _drawn("path", F.col("pattern")) % 4 == 0)
    once = parents.union(paths)
    entries = begun.select("pattern", F.lit("add").alias("action"), "at").union(
        ended.select("pattern", F.lit("remove"), "at")).union(
        once.select("pattern", F.lit("add"), _drawn("add", F.col("pattern"), "once") % year))
    return urls.listed_captures(pages, entries).fillna(-1, ["valid_from"])


SQL["op4_temporal_url_lists"] = r"""
WITH page AS (
  SELECT page_id, url, ('0x' || substr(md5('fetched:' || page_id), 1, 8))::BIGINT % 31536000 AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)', 1), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
host AS (SELECT DISTINCT host AS pattern FROM page WHERE host <> ''),
cycle AS (
  SELECT pattern, k, ('0x' || substr(md5('add:' || pattern || ':' || k), 1, 8))::BIGINT % 31536000 AS begun
  FROM host, (SELECT unnest(['0', '1', '2']) AS k) WHERE ('0x' || substr(md5('host:' || pattern), 1, 8))::BIGINT % 2 = 0),
parent AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM host),
path AS (
  SELECT DISTINCT host || '/' || array_to_string(parts[1:1 + (('0x' || substr(md5('depth:' || url), 1, 8))::BIGINT % len(parts))], '/') AS pattern
  FROM page WHERE host <> '' AND len(parts) > 0),
once AS (
  SELECT pattern FROM parent WHERE ('0x' || substr(md5('parent:' || pattern), 1, 8))::BIGINT % 2 = 0
  UNION ALL SELECT pattern FROM path WHERE ('0x' || substr(md5('path:' || pattern), 1, 8))::BIGINT % 4 = 0),
entry AS (
  SELECT pattern, TRUE AS valid, begun AS moment FROM cycle
  UNION ALL SELECT pattern, FALSE, begun + 86400 * (20 + ('0x' || substr(md5('remove:' || pattern || ':' || k), 1, 8))::BIGINT % 60) FROM cycle
  UNION ALL SELECT pattern, TRUE, ('0x' || substr(md5('add:' || pattern || ':once'), 1, 8))::BIGINT % 31536000 FROM once),
at_once AS (SELECT pattern, moment, bool_or(valid) AS valid FROM entry GROUP BY ALL),
change AS (
  SELECT * FROM (SELECT *, lag(valid, 1, FALSE) OVER (PARTITION BY pattern ORDER BY moment) AS was FROM at_once) WHERE valid <> was),
span AS (
  SELECT pattern, moment AS valid_from, nxt AS valid_to
  FROM (SELECT *, lead(moment) OVER (PARTITION BY pattern ORDER BY moment) AS nxt FROM change) WHERE valid),
capture AS (SELECT page_id, url, fetched_at, host, parts, count(*) AS n_rows FROM page GROUP BY ALL),
wide AS (
  SELECT DISTINCT page_id, url, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM capture WHERE host <> ''),
met AS (
  SELECT w.*, s.valid_from, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(w.pattern) DESC, w.pattern, valid_from) AS place,
         count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n_patterns
  FROM wide w JOIN span s ON w.pattern = s.pattern AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT c.page_id, c.url, c.fetched_at, c.n_rows, m.pattern IS NOT NULL AS listed, coalesce(m.n_patterns, 0) AS n_patterns,
       m.pattern, coalesce(m.valid_from, -1) AS valid_from
FROM capture c LEFT JOIN met m ON m.place = 1 AND c.page_id = m.page_id AND c.url = m.url AND c.fetched_at = m.fetched_at
"""


@register
def op5_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    model = kneser_ney.KneserNey.fit(docs.filter(~held_out(F.col("doc_id"), 10, 0)), order=3)
    return model.score(docs).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 10, 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op6_winnowing_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_contamination(read(spark, d, "documents"), read(spark, d, "benchmark"))


@register
def op7_cnn_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    labels = read(spark, d, "labels").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"), 3, 1)))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "score", "predicted", "language")


@register
def op8_minhash_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, d, "documents"))


@register
def op9_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return packing.pack_documents(docs, packing.token_count(F.col("text")))


@register
def op10_reversible_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return lines.LineIndex.build(docs).apply(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL["op10_reversible_line_dedup"] = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, key FROM keyed WHERE length(key) >= 40)
  GROUP BY key HAVING count(*) >= 5),
judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id < o.last_doc AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op6_winnowing_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n,
         unnest(list_transform(range(1, greatest(len(words) - 12, 1) + 1), lambda i: array_to_string(words[i:i + least(len(words), 13) - 1], ' '))) AS w
  FROM item WHERE len(words) > 0),
kinds AS (SELECT DISTINCT n FROM win),
span AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i,
         unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS w
  FROM doc, kinds WHERE len(words) >= n),
met AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM span s JOIN win ON s.w = win.w AND s.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@register
def op13_filter_orders(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_orders(filter_audit.failed_filters(read(spark, d, "documents"), read(spark, d, "labels")))


SQL["op13_filter_orders"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
earliest AS (SELECT text, min(doc_id) AS first_id FROM doc GROUP BY text),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, FALSE)} AS f
  FROM doc d LEFT JOIN earliest USING (text) LEFT JOIN label USING (doc_id)),
failing AS (
  SELECT part, CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END
         || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END AS failed,
         count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ordered AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
played AS (
  SELECT part, filter_order, failed, n, good, bad,
         list_position(list_transform(string_split(filter_order, ''), lambda l: failed LIKE '%' || l || '%'), TRUE) AS gone_at
  FROM failing, ordered),
step AS (SELECT unnest(range(1, 6))::INT AS step),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own,
         sum(CASE WHEN gone_at IS NULL OR gone_at > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone_at < step AND failed LIKE '%' || substr(filter_order, step, 1) || '%' THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone_at = step THEN bad ELSE 0 END) AS toxic_lost
  FROM played, step GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


#: The tokenizer files of the query; tasks read them by these paths.
TOKENIZERS = os.environ.get("TEXTMILL_TOKENIZERS", "/opt/tokenizers")


@register
def op12_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return alignment.Alignment.build(docs, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model").of_rows(docs)


@register
def op11_repeated_substrings(spark: SparkSession, d: str) -> DataFrame:
    left = substrings.without_repeated_substrings(read(spark, d, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
