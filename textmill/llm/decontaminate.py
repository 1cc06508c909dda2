"""Benchmark decontamination by winnowing.

A text's fingerprints are the hashes of its runs of K words that are the smallest of
some window of W neighbouring runs.  Two texts that share K + W - 1 = 13 words choose
the same run in them, so every shared window of 13 words shows as a shared
fingerprint.  A shared fingerprint is extended word by word to both sides; K plus the
equal words beside it make a hit if they reach 13.  A benchmark item of fewer words
is one window, found by the hash of all its words.

The fingerprints of the documents are joined with those of the benchmark; beforehand
a bit map of fixed size, set by the benchmark's fingerprints, drops most that have no
partner.  It is a filter only, so a benchmark of any size gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.tables import stored
from textmill.llm.words import lower_ascii

SPAN, K = 13, 7
W = SPAN - K + 1
SIDE = SPAN - K
#: Bits of the filter, a power of two.
FILTER_BITS = 1 << 20
_MARKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def bench_words(text: Column) -> Column:
    """Words of letters, digits and what is beyond ASCII, A-Z in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _MARKS), "")


def _runs(words: str, k: int) -> Column:
    """Hash of every run of k words; none if there are fewer."""
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(
        F.array().cast("array<bigint>"))


def _chosen(runs: str, i: Column) -> Column:
    """Whether run i (from 0) is the smallest of some window of W runs that holds it.

    That is so if the larger ones around it, at both sides, fill a window; the ends
    of the text cut windows short only when it has fewer than W runs.
    """
    here = F.get(F.col(runs), i)
    windows = F.sequence(F.greatest(F.lit(0), i - (W - 1)), F.greatest(F.lit(0), F.least(i, F.size(runs) - W)))
    return F.exists(windows, lambda j: F.array_min(F.slice(F.col(runs), j + 1, W)) == here)


def _context(words: str, i: Column, k: int) -> tuple[Column, Column, Column]:
    """The words before (nearest first), inside and after the run of k words at i."""
    side = SIDE if k == K else 0
    before = F.reverse(F.slice(words, F.greatest(i - side, F.lit(0)) + 1, F.least(i, F.lit(side))))
    return before, F.slice(words, i + 1, k), F.slice(words, i + k + 1, side)


def _winnowed(candidates: str, runs: str) -> Column:
    return F.filter(candidates, lambda x: _chosen(runs, x["i"]))


def _spots(chosen: Column, kind: int, k: int) -> Column:
    """The chosen runs with the words in and around them."""
    def spot(x: Column) -> Column:
        before, inside, after = _context("words", x["i"], k)
        return F.struct(F.lit(kind).alias("k"), x["i"].alias("i"), x["hash"].alias("hash"), before.alias("before"),
                        inside.alias("inside"), after.alias("after"))

    return F.transform(chosen, spot)


def _surviving(runs: str, bitmap: Column) -> Column:
    """(i, hash) of the runs that the filter lets through."""
    return F.filter(F.transform(runs, lambda h, i: F.struct(i.alias("i"), h.alias("hash"))),
                    lambda x: _passes(bitmap, x["hash"]))


def item_fingerprints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, hash, item, before, inside, after): the fingerprints of the items, with the words around."""
    words = items.select(F.col(id_col).cast("string").alias("item"), bench_words(F.col(text_col)).alias("words")).filter(
        F.size("words") > 0)
    long = words.filter(F.size("words") >= SPAN).withColumn("runs", _runs("words", K)).select(
        "item", "words", F.lit(K).alias("k"), F.explode(F.filter(
            F.transform("runs", lambda h, i: F.struct(i.alias("i"), h.alias("hash"))),
            lambda x: _chosen("runs", x["i"]))).alias("f"))
    before, inside, after = _context("words", F.col("f.i"), K)
    short = words.filter(F.size("words") < SPAN)
    none = F.array().cast("array<string>")
    # A short item's k is its negative length, apart from the runs of K words of long ones.
    return long.select("k", F.col("f.hash").alias("hash"), "item", before.alias("before"), inside.alias("inside"),
                       after.alias("after")).union(
        short.select(-F.size("words"), F.xxhash64("words"), "item", none, "words", none)).distinct()


def _bitmap(prints: DataFrame, k: int) -> Column | None:
    """The filter as a constant array of 64-bit numbers; None if no item has such a fingerprint."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (prints.filter(F.col("k") == k).select(bit.alias("bit")).distinct()
             .groupBy(F.shiftright("bit", 6).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).collect())
    if not words:
        return None
    filled = [0] * (FILTER_BITS >> 6)
    for r in words:
        filled[r["w"]] = r["bits"]
    return F.from_json(F.lit("[" + ",".join(map(str, filled)) + "]"), "array<bigint>")


def _passes(bitmap: Column, h: Column) -> Column:
    word = F.get(bitmap, F.shiftright(h.bitwiseAND(F.lit(FILTER_BITS - 1)), 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A null text has no words.  Items without words match nothing; an item without id
    marks words but is not counted or listed.  Rows of the same id and text share
    their result, each in a row of its own.
    """
    prints = stored(item_fingerprints(items, item_col, item_text_col), "fingerprints")
    kinds = sorted(r["k"] for r in prints.select("k").distinct().collect())  # at most 13 values
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.concat_ws(
        ":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)).alias("key"),
        bench_words(F.col(text_col)).alias("words"))
    found = []
    for kind in kinds:
        k, name = (kind if kind == K else -kind), f"runs{abs(kind)}{'' if kind == K else 's'}"
        bitmap = _bitmap(prints, kind)
        words = words.withColumn(name, _runs("words", k)).withColumn(f"{name}_b", _surviving(name, bitmap))
        chosen = _winnowed(f"{name}_b", name) if kind == K else F.col(f"{name}_b")
        found.append(_spots(chosen, kind, k))
    spots = F.concat(*found) if found else F.array().cast(
        "array<struct<k:int,i:int,hash:bigint,before:array<string>,inside:array<string>,after:array<string>>>")
    read = stored(words.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), spots.alias("spots")), "spots")

    d = read.select("key", F.explode("spots").alias("s")).select("key", "s.*").distinct().alias("d")
    p = prints.alias("p")

    def equal(a: str, b: str) -> Column:
        """How many words the two lists have in common from their beginning."""
        n = F.least(F.size(a), F.size(b))
        differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
        return F.when(differs > 0, differs - 1).otherwise(n).cast("long")

    met = (d.join(p, (F.col("d.k") == F.col("p.k")) & (F.col("d.hash") == F.col("p.hash"))
                  & (F.col("d.inside") == F.col("p.inside")))
           .select("key", "item", F.col("d.i").cast("long").alias("i"), F.size("d.inside").cast("long").alias("n"),
                   equal("d.before", "p.before").alias("left"), equal("d.after", "p.after").alias("right"),
                   F.when(F.col("d.k") == K, SPAN).otherwise(F.size("d.inside")).alias("least"))
           .filter("left + n + right >= least")
           .select("key", "item", (F.col("i") - F.col("left")).alias("a"), (F.col("i") + F.col("n") + F.col("right")).alias("b")))
    hits = stored(met.distinct(), "hits")
    covered = hits.select("key", F.explode(F.sequence("a", F.col("b") - 1)).alias("w")).distinct().groupBy("key").agg(
        F.count("*").alias("n_hit"))
    listed = hits.select("key", "item").distinct().groupBy("key").agg(
        F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))
    hit, count = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("n_items", F.lit(0)).cast("long")
    return read.select("doc_id", "key", "n_words").join(covered.join(listed, "key"), "key", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), count.alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))
