"""Text functions: cleaning, tokens, hashes and shingles.

All are built-in expressions, so they run inside the JVM.  Patterns name the
whitespace characters one by one, because ``\\s`` differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.fixed_values import HTML_ENTITIES, STOPWORDS
from textmill.functions.exprs import col, let

_SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{_SPACE}]"
NON_SPACE = f"[^{_SPACE}]"


def strip(c: Column | str) -> Column:
    """Remove whitespace at both ends."""
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse_spaces(c: Column | str) -> Column:
    """Runs of whitespace become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def _where(text: Column, signs: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that hold one of the signs; the others pass after a plain search."""
    def body(t: Column) -> Column:
        found = reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])
        return F.when(found, change(t)).otherwise(t)

    return let(text, body)


def _decoded(text: Column) -> Column:
    for entity, char in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_html(c: Column | str) -> Column:
    """Tags become blanks, then six entities are decoded one after another."""
    untagged = _where(col(c), ["<"], lambda t: F.regexp_replace(t, "<[^>]+>", " "))
    return _where(untagged, ["&"], _decoded)


def remove_urls(c: Column | str) -> Column:
    return _where(col(c), ["://", "www."],
                  lambda t: F.regexp_replace(t, rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+", " "))


def remove_emails(c: Column | str) -> Column:
    """Remove words of the form x@y.z.

    A match starts at the head of a word and the first ``@`` after its first
    character decides, so nothing is tried twice: linear in the text.  Texts
    without ``@`` are passed through unseen.
    """
    pattern = (
        rf"(?<!{NON_SPACE}){NON_SPACE}[^@{_SPACE}]*+@{NON_SPACE}+\.{NON_SPACE}+"
    )
    return _where(col(c), ["@"], lambda t: F.regexp_replace(t, pattern, " "))


def letters_only(c: Column | str) -> Column:
    """Every run of characters other than a-z (after lower-casing) is one blank."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z]+", " ")


def word_tokens(c: Column | str) -> Column:
    """Words between blanks; an empty text has none."""
    return F.filter(F.split(col(c), " +"), lambda t: t != "")


def remove_stopwords(tokens: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stopwords))


def remove_short_tokens(tokens: Column, min_length: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= min_length)


def preprocess_tokens(
    c: Column | str,
    remove_stops: bool = True,
    min_token_length: int = 2,
    remove_html: bool = True,
    stopwords: Sequence[str] = STOPWORDS,
) -> Column:
    """Tokens of the cleaned text, kept in order."""
    out = clean_html(c) if remove_html else col(c)
    tokens = F.split(letters_only(remove_emails(remove_urls(out))), " ")
    # One pass instead of three: empty tokens are shorter than any minimum.
    floor = max(1, min_token_length)
    if remove_stops:
        return F.filter(tokens, lambda t: (F.length(t) >= floor) & ~t.isin(*stopwords))
    return F.filter(tokens, lambda t: F.length(t) >= floor)


def preprocess(c: Column | str, **options) -> Column:
    """Cleaned text: tags, addresses, non-letters, stopwords and short tokens out."""
    return F.array_join(preprocess_tokens(c, **options), " ")


def normalized_text(c: Column | str) -> Column:
    return collapse_spaces(F.lower(col(c)))


def text_hash(c: Column | str) -> Column:
    """MD5 of the lower-cased, whitespace-collapsed text."""
    return F.md5(normalized_text(c))


def char_ngrams(c: Column | str, n: int) -> Column:
    """All character n-grams in order of position (look-ahead, so they overlap)."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s)(?=({'.' * n}))"), 1)


def text_shingles(c: Column | str, n_shingles: int | None = None) -> Column:
    """Distinct character 3-grams of the normalised text.

    A text below three characters is its own shingle.  ``n_shingles`` keeps the
    n smallest by hash; by default all stay.
    """
    body = let(
        normalized_text(c),
        lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(
            F.array_distinct(char_ngrams(t, 3))
        ),
    )
    if n_shingles is None:
        return body
    ranked = F.sort_array(F.transform(body, lambda g: F.struct(F.md5(g).alias("h"), g.alias("g"))))
    return F.transform(F.slice(ranked, 1, n_shingles), lambda s: s["g"])


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two duplicate-free arrays, 0 when one is empty."""
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        inter / (F.size(a) + F.size(b) - inter)
    )


def sample_prefix(c: Column | str, n: int = 100) -> Column:
    return F.substring(col(c), 1, n)
