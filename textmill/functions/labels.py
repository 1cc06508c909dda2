"""Label functions: normalisation, taxonomy and mislabel detection.

The tables behind them are constants of at most 70 entries, so they are inlined
as literals: no join, no shuffle, and usable on a stream as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.config import ConfidenceThresholds
from textmill.fixed_values import (
    INSURANCE_WORDS,
    INSURER_PHRASES,
    KEYWORD_GROUPS,
    LABEL_MAP,
    ROOT_LABEL,
    SUGGESTED_LABELS,
    TAXONOMY,
    UNKNOWN_LABEL,
)
from textmill.functions.exprs import col, let, lookup
from textmill.functions.text import strip

LEAF_PATHS: dict[str, tuple[str, str, str]] = {
    leaf: (domain, spec, leaf)
    for domain, specs in TAXONOMY.items()
    for spec, leaves in specs.items()
    for leaf in leaves
}
_SPEC_PARENTS = {spec: domain for domain, specs in TAXONOMY.items() for spec in specs}
# Where a name is both a specialisation and a leaf, the leaf entry holds.
PARENTS: dict[str, str] = {**_SPEC_PARENTS, **{leaf: p[1] for leaf, p in LEAF_PATHS.items()}}


# -- labels -----------------------------------------------------------------

def validate_label(c: Column | str) -> Column:
    """Stripped label; null and blank become "Unknown"."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(UNKNOWN_LABEL))


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(col(c), r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def is_leaf(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(*LEAF_PATHS), F.lit(False))


def normalize_label(c: Column | str, mapping: Mapping[str, str] = LABEL_MAP) -> Column:
    """Canonical label: table, then table after ``_`` to blank, then taxonomy,
    then the same on the title-cased form; what is left stays as it is, except
    that all-capitals become title case."""

    def known(label: Column) -> Column:
        return F.coalesce(lookup(mapping, label), F.when(is_leaf(label), label))

    def resolve(raw: Column) -> Column:
        spaced = F.replace(raw, F.lit("_"), F.lit(" "))
        all_caps = (F.upper(spaced) == spaced) & (F.lower(spaced) != spaced)
        by_title = let(
            title_case(spaced),
            lambda t: F.coalesce(known(t), F.when(all_caps, t), spaced),
        )
        return F.coalesce(lookup(mapping, raw), known(spaced), by_title)

    stripped = F.nullif(strip(c), F.lit(""))
    return F.coalesce(let(stripped, resolve), F.lit(UNKNOWN_LABEL))


# -- taxonomy ---------------------------------------------------------------

def taxonomy(spark: SparkSession) -> DataFrame:
    """(domain, specialization, leaf), one row per leaf."""
    return spark.createDataFrame(
        list(LEAF_PATHS.values()), "domain string, specialization string, leaf string"
    )


def label_path(c: Column | str) -> Column:
    """[domain, specialisation, leaf]; an unknown label hangs below the root."""
    pairs = [
        F.lit(x) if isinstance(x, str) else F.array(*[F.lit(p) for p in x])
        for leaf, path in LEAF_PATHS.items()
        for x in (leaf, path)
    ]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), col(c)),
        F.when(col(c).isNotNull(), F.array(F.lit(ROOT_LABEL), col(c))),
    )


def label_parent(c: Column | str) -> Column:
    """Specialisation of a leaf, domain of a specialisation, else null."""
    return lookup(PARENTS, col(c))


def label_domain(c: Column | str) -> Column:
    return F.coalesce(
        lookup({leaf: p[0] for leaf, p in LEAF_PATHS.items()}, col(c)), F.lit(ROOT_LABEL)
    )


def label_specialization(c: Column | str) -> Column:
    """Second path element: for an unknown label that is the label itself."""
    return F.coalesce(lookup({leaf: p[1] for leaf, p in LEAF_PATHS.items()}, col(c)), col(c))


def climb(c: Column | str, levels: int | Column = 1) -> Column:
    """The ancestor ``levels`` above the label, stopping at the head of its path."""
    up = F.lit(levels) if isinstance(levels, int) else levels
    return let(
        label_path(c),
        lambda p: F.element_at(p, F.greatest(F.lit(1), F.size(p) - up).cast("int")),
    )


def consensus_domain(labels: Column) -> Column:
    """Most frequent domain of a label array; the first seen wins a tie."""

    def best(domains: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("d"), F.lit(0).alias("n"))

        def step(acc: Column, d: Column) -> Column:
            n = F.size(F.filter(domains, lambda x: x == d))
            return F.when(n > acc["n"], F.struct(d.alias("d"), n.alias("n"))).otherwise(acc)

        return F.aggregate(domains, start, step, lambda acc: acc["d"])

    return F.coalesce(
        let(F.transform(labels, label_domain), best), F.lit(ROOT_LABEL)
    )


def select_by_confidence(
    predicted: Column,
    confidence: Column,
    top_labels: Column | None = None,
    thresholds: ConfidenceThresholds = ConfidenceThresholds(),
) -> Column:
    """Struct with the label at the depth the confidence allows."""
    high = confidence >= thresholds.high
    medium = confidence >= thresholds.medium
    two_up = climb(predicted, 2)
    if top_labels is None:
        fallback, suggestions = two_up, F.lit(None).cast("array<string>")
    else:
        fallback = F.when(F.size(top_labels) > 0, consensus_domain(top_labels)).otherwise(two_up)
        suggestions = F.when(~medium & ~high, top_labels)
    return F.struct(
        F.when(high, predicted)
        .when(medium, climb(predicted, 1))
        .otherwise(fallback)
        .alias("category"),
        predicted.alias("specific_category"),
        confidence.alias("confidence"),
        F.when(high, "high").when(medium, "medium").otherwise("low").alias("tier"),
        label_path(predicted).alias("path"),
        (~(high | medium)).alias("requires_review"),
        suggestions.alias("top_suggestions"),
    )


# -- mislabel detection -----------------------------------------------------

def keyword_score(lowered: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur as substrings of the lower-cased text."""
    hits = [F.contains(lowered, F.lit(t)).cast("int") for t in terms]
    return sum(hits[1:], hits[0])


def detect_mislabel(
    text: Column | str,
    label: Column | str,
    groups: Mapping[str, Sequence[str]] = KEYWORD_GROUPS,
) -> Column:
    """Suggested label where the text contradicts the label, else null.

    Only rows labelled AUTOMOBILE or BPO are judged, so the scores sit inside
    the label branches and other rows pay one comparison.
    """

    def any_of(lowered: Column, phrases: Sequence[str]) -> Column:
        found = [F.contains(lowered, F.lit(p)) for p in phrases]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out

    def automobile(lowered: Column) -> Column:
        names = ["automobile"] + [g for g, _ in SUGGESTED_LABELS]
        scores = F.struct(*[keyword_score(lowered, groups[g]).alias(g) for g in names])

        def judge(s: Column) -> Column:
            rival = F.greatest(*[s[g] for g, _ in SUGGESTED_LABELS])
            outscored = (s["automobile"] < 2) & (rival > s["automobile"])
            by_group = F.coalesce(
                *[F.when(s[g] == rival, F.lit(name)) for g, name in SUGGESTED_LABELS]
            )
            insurer = any_of(lowered, INSURER_PHRASES) & (
                (s["finance"] >= 2) | any_of(lowered, INSURANCE_WORDS)
            )
            return F.when(outscored, by_group).when(insurer, F.lit("Finance"))

        return let(scores, judge)

    def bpo(lowered: Column) -> Column:
        scores = F.struct(
            keyword_score(lowered, groups["bpo"]).alias("bpo"),
            keyword_score(lowered, groups["it"]).alias("it"),
        )
        return let(
            scores,
            lambda s: F.when(
                (s["bpo"] < 2) & (s["it"] > s["bpo"]), F.lit("Information-Technology")
            ),
        )

    upper = F.upper(col(label))
    return F.when(upper == "AUTOMOBILE", let(F.lower(col(text)), automobile)).when(
        upper == "BPO", let(F.lower(col(text)), bpo)
    )
