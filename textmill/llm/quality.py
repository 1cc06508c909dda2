"""Quality rules by distribution divergence.

A language's reference is the share of each class of characters in all its texts
(classes of ASCII and of groups of scripts), and the share of its most common words.  A text is compared with the references by
Jensen-Shannon distance (0: equal, 1: nothing in common); it fails if even the
nearest reference is too far, in characters or in words.  Too short a text is not
judged by its shares.  Everything is built-in column functions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.tables import stored
from textmill.llm.words import space_words

#: Classes of characters by their pattern, first of ASCII, then of the rest; a-z, the
#: most frequent, is the last class.
ASCII = {"upper": "[A-Z]", "digit": "[0-9]", "other": "[\\x00-\\x08\\x0E-\\x1F!-/:-@\\[-`{-\\x7F]"}
BEYOND = {"latin": "[\\u00C0-\\u024F\\u1E00-\\u1EFF]", "greek_cyrillic": "[\\u0370-\\u052F]", "semitic": "[\\u0590-\\u08FF]",
          "indic": "[\\u0900-\\u0DFF]", "east_asian": "[\\u1100-\\u11FF\\u2E80-\\uD7FF\\uF900-\\uFAFF\\uFF00-\\uFFEF\\x{20000}-\\x{3FFFF}]"}
SYMBOLS = "[#*$%&|<>]"
_LINE_WORD = "[^\\x20\\x09-\\x0D]"
_BUCKETS = 256
#: Common words are told apart by a set of literals up to so many, else by their buckets.
_LITERALS = 2000
#: Bits of a number that hold a window's place; the rest holds its hash.
_PLACE = 26


def _matches(text: str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def with_class_counts(df: DataFrame) -> DataFrame:
    """``df`` (text, ...) with the code points of each class as columns; ``foreign`` is all beyond
    ASCII of no other class.  Most of a text is a-z, so that is cut out once and the classes are
    counted in what is left; in the same way, what is beyond ASCII is cut out of that."""
    rest = df.withColumn("rest", F.regexp_replace("text", "[a-z]+", "")).withColumn(
        "lower", (F.length("text") - F.length("rest")).cast("long"))
    beyond = rest.withColumn("beyond", F.when(F.octet_length("rest") == F.length("rest"), "").otherwise(
        F.regexp_replace("rest", "[\\x00-\\x7F]+", "")))
    named = beyond.withColumns({c: _matches("rest", p) for c, p in ASCII.items()} | {c: _matches("beyond", p) for c, p in BEYOND.items()})
    return named.withColumn("foreign", F.length("beyond") - sum((F.col(c) for c in BEYOND), F.lit(0)))


CLASSES = [*ASCII, *BEYOND, "foreign"]


def repeated_words(words: str) -> Column:
    """Words in runs of three words that occur twice or more.

    The runs are sorted by part of their hash, so equal ones are neighbours; those
    with an equal neighbour are compared by their words.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.shiftleft(
        F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)), _PLACE).bitwiseOR(i.cast("long")))

    def close(a: Column, b: Column) -> Column:
        return F.shiftright(a, _PLACE) == F.shiftright(b, _PLACE)

    def alike(ordered: Column) -> Column:
        near = F.filter(ordered, lambda x, j: close(x, F.get(ordered, j - 1)) | close(x, F.get(ordered, j + 1)))
        run = F.sort_array(F.transform(near, lambda x: _run(words, x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int"))))
        return F.transform(F.array(run), lambda r: F.sort_array(F.transform(F.filter(
            r, lambda x, j: (x["run"] == F.get(r, j - 1)["run"]) | (x["run"] == F.get(r, j + 1)["run"])),
            lambda x: x["i"])))[0]

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3), lambda s, x: s + x)).otherwise(0)

    def once(value: Column, then) -> Column:
        return F.transform(F.array(value), then)[0]

    return F.when(n >= 3, once(F.sort_array(hashed), lambda s: once(alike(s), covered))).otherwise(0).cast("long")


def _run(words: str, i: Column) -> Column:
    return F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("run"), i.alias("i"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts, the words, and the characters of each class (array ``chars``, a-z last)."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = text.withColumn("words", space_words(F.col("text")))
    every = [F.col(c).cast("long") for c in [*CLASSES, "lower"]]
    return with_class_counts(words).select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
        sum(every[1:], every[0]).alias("word_chars"), _matches("rest", SYMBOLS).alias("n_symbols"), F.array(*every).alias("chars"))


@dataclass(frozen=True)
class Reference:
    """One language: the shares of the classes of characters, and of its common words
    (by their codes) with all other words last."""

    language: str
    chars: list[float]
    codes: list[int]
    words: list[float]


@dataclass(frozen=True)
class References:
    languages: list[Reference]
    #: Common words by bucket; a word's code is made of its bucket and place.
    buckets: list[list[str]]


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 24) -> References:
    """References from all rows with a language, for every language whose texts have a word.

    Only the shares and the ``common`` words of each language reach the driver.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    classes = [*CLASSES, "lower"]
    sums = {r["lang"]: r for r in with_class_counts(rows).groupBy("lang").agg(*[F.sum(c).alias(c) for c in classes]).filter(
        " + ".join(classes) + " > 0").collect()}
    counted = stored(rows.select("lang", F.explode(space_words(F.col("text"))).alias("word")).groupBy(
        "lang", "word").count(), "word-counts")
    first = counted.withColumn("place", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).filter(F.col("place") <= common).select(
        "lang", "word", "count", "place", F.pmod(F.hash("word"), F.lit(_BUCKETS)).alias("bucket"))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
    top = first.collect()
    top = sorted((r for r in top if r["lang"] in sums), key=lambda r: (r["lang"], r["place"]))
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for r in top:
        if r["word"] not in buckets[r["bucket"]]:
            buckets[r["bucket"]].append(r["word"])
    languages = []
    for lang, s in sorted(sums.items()):
        own = [r for r in top if r["lang"] == lang]
        chars = [s[c] for c in classes]
        shares = [r["count"] / totals[lang] for r in own]
        languages.append(Reference(
            lang, [c / max(1, sum(chars)) for c in chars],
            [r["bucket"] + _BUCKETS * (1 + buckets[r["bucket"]].index(r["word"])) for r in own],
            [*shares, max(0.0, 1.0 - sum(shares))]))
    return References(languages, buckets)


def _divergence(p: Column, q: Column) -> Column:
    """What one kind adds to twice the Jensen-Shannon divergence; q where p is 0."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    return part(p, (p + q) / 2) + part(q, (p + q) / 2)


def js_distance(counts: Column, total: Column, shares: Column | Sequence[float]) -> Column:
    """Jensen-Shannon distance of counts and shares, between 0 and 1."""
    shares = shares if isinstance(shares, Column) else F.array(*map(F.lit, shares))
    terms = F.zip_with(counts, shares, lambda c, q: _divergence(c / total, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _with_common_words(m: DataFrame, references: References) -> DataFrame:
    """Adds ``terms``: for each different common word of the text, and each language that lists
    it, how often it occurs and how far it moves that language's divergence."""
    listed: list[list[dict]] = [[] for _ in references.buckets]
    for b, bucket in enumerate(references.buckets):
        listed[b] = [{"word": w, "of": []} for w in bucket]
    for i, r in enumerate(references.languages):
        for code, share in zip(r.codes, r.words):
            listed[code % _BUCKETS][code // _BUCKETS - 1]["of"].append({"reference": i, "share": share})
    table = F.from_json(F.lit(json.dumps(listed)), "array<array<struct<word:string,of:array<struct<reference:int,share:double>>>>>")

    def entry(w: Column) -> Column:
        return F.filter(F.get(table, F.pmod(F.hash(w), F.lit(_BUCKETS))), lambda e: e["word"] == w)

    words = [w for b in references.buckets for w in b]
    common = F.filter("words", lambda w: w.isin(words) if len(words) <= _LITERALS else F.size(entry(w)) > 0)
    m = m.withColumn("common", F.sort_array(common))
    # Equal words are neighbours now; the place where each run of them ends gives its length.
    ends = F.filter(F.sequence(F.lit(1), F.size("common")), lambda j: (j == F.size("common")) | (
        F.get("common", j) != F.get("common", j - 1)))
    m = m.withColumn("ends", F.when(F.size("common") > 0, ends).otherwise(F.array().cast("array<int>")))
    met = F.transform("ends", lambda j, i: F.struct(
        F.get("common", j - 1).alias("word"), (j - F.coalesce(F.get("ends", i - 1), F.lit(0))).cast("long").alias("n")))
    return m.withColumn("terms", F.flatten(F.transform(met, lambda x: F.flatten(F.transform(entry(x["word"]), lambda e: F.transform(
        e["of"], lambda o: F.struct(o["reference"].alias("reference"), x["n"].alias("n"), (
            _divergence(x["n"] / F.col("n_words"), o["share"]) - o["share"]).alias("more"))))))))


def judge(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 250,
          min_words: int = 50, max_char_distance: float = 0.3, max_word_distance: float = 0.5) -> DataFrame:
    """Base counts, base_failed, kept, and the distances and nearest language, one row for each row.

    A null text is empty.  A distance is null where the text has fewer characters or
    words than the guard asks for, or if there is no reference; such a text passes the rule.
    """
    m = measured(docs, id_col, text_col)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_LINE_WORD))
    m = m.withColumn("lines", lines).withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeated_words("words")})
    if references.languages:
        m = _with_common_words(m, references)
        # One expression for all references, so the plan does not grow with the languages.
        every = F.from_json(F.lit(json.dumps([
            {"language": r.language, "chars": r.chars, "listed": sum(r.words[:-1]), "rest": r.words[-1]} for r in references.languages])),
            "array<struct<language:string,chars:array<double>,listed:double,rest:double>>")

        def distances(r: Column, i: Column) -> Column:
            own = F.filter("terms", lambda t: t["reference"] == i)
            # A listed word that does not occur adds its share.
            both = F.aggregate(own, F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")), lambda s, t: F.struct(
                (s["sum"] + t["more"]).alias("sum"), (s["n"] + t["n"]).alias("n")))
            twice = F.transform(F.array(both), lambda s: r["listed"] + s["sum"] + _divergence(
                (F.col("n_words") - s["n"]) / F.col("n_words"), r["rest"]))[0]
            return F.struct(
                F.sqrt(F.greatest(F.lit(0.0), F.round(twice / 2, 14))).alias("word_distance"),  # equal shares give exactly 0
                js_distance(F.col("chars"), F.col("word_chars"), r["chars"]).alias("char_distance"),
                r["language"].alias("language"))

        m = m.withColumn("near", F.when(F.col("n_words") > 0, F.array_min(F.transform(every, distances))))
    else:
        m = m.withColumn("near", F.lit(None).cast("struct<word_distance:double,char_distance:double,language:string>"))
    enough = {"char_distance": F.col("word_chars") >= min_chars, "word_distance": F.col("n_words") >= min_words}
    m = m.withColumns({c: F.when(ok, F.col(f"near.{c}")) for c, ok in enough.items()})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    close = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & close).alias("kept"), "char_distance", "word_distance",
                    F.col("near.language").alias("nearest_language"))
