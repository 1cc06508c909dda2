"""Pieces of SQL for restating the text and label functions in another engine."""

from __future__ import annotations

from textmill.fixed_values import (
    HTML_ENTITIES, INSURANCE_WORDS, INSURER_PHRASES, KEYWORD_GROUPS, LABEL_MAP, ROOT_LABEL,
    STOPWORDS, SUGGESTED_LABELS,
)
from textmill.functions.labels import LEAF_PATHS, PARENTS
from textmill.functions.text import NON_SPACE, SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def regex(e: str, pattern: str, by: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"


def strip(e: str) -> str:
    return regex(e, rf"\A{SPACE}+|{SPACE}+\z", "")


def normalized(e: str) -> str:
    return f"trim({regex(f'lower({e})', SPACE + '+', ' ')})"


def text_hash(e: str) -> str:
    return f"md5({normalized(e)})"


def clean_html(e: str) -> str:
    out = regex(e, "<[^>]+>", " ")
    for entity, char in HTML_ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def remove_urls(e: str) -> str:
    return regex(e, rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+", " ")


def remove_emails(e: str) -> str:
    return regex(e, rf"{NON_SPACE}+@{NON_SPACE}+\.{NON_SPACE}+", " ")


def letters(e: str) -> str:
    return regex(f"lower({e})", "[^a-z]+", " ")


def tokens(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda t: t <> '')"


def preprocess_tokens(e: str, stops: bool = True, least: int = 2, html: bool = True) -> str:
    base = letters(remove_emails(remove_urls(clean_html(e) if html else e)))
    keep = f"length(t) >= {max(1, least)}"
    if stops:
        keep += f" and not list_contains({qlist(STOPWORDS)}, t)"
    return f"list_filter(string_split({base}, ' '), lambda t: {keep})"


def preprocess(e: str, **options) -> str:
    return f"array_to_string({preprocess_tokens(e, **options)}, ' ')"


def shingles(e: str) -> str:
    """Distinct 3-grams as a list; a text below three characters is its own."""
    n = normalized(e)
    grams = (
        f"list_distinct([a[1] || a[2] || a[3] for a in list_zip("
        f"string_split({n}, '')[1:-3], string_split({n}, '')[2:-2], string_split({n}, '')[3:])])"
    )
    return f"case when length({n}) < 3 then [{n}] else {grams} end"


def hash_hex(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def hash_int(*parts: str) -> str:
    return f"('0x' || substr({hash_hex(*parts)}, 1, 8))::bigint"


def pick(values, *parts: str) -> str:
    return f"{qlist(values)}[({hash_int(*parts)} % {len(values)}) + 1]"


# -- labels -----------------------------------------------------------------

def case_lookup(e: str, table: dict[str, str]) -> str:
    return f"case {e} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + " end"


def title(e: str) -> str:
    return (
        f"array_to_string([upper(x[1]) || lower(x[2:]) "
        rf"for x in regexp_extract_all({e}, '\pL+|\PL+')], '')"
    )


def is_leaf(e: str) -> str:
    return f"coalesce({e} in ({', '.join(q(v) for v in LEAF_PATHS)}), false)"


def label_table(source: str) -> str:
    """CTE body (raw, label) over the distinct raw labels of ``source(raw)``."""
    known = lambda e: f"coalesce({case_lookup(e, LABEL_MAP)}, case when {is_leaf(e)} then {e} end)"
    return f"""
      select raw, case when s is null or s = '' then 'Unknown' else coalesce(
          {case_lookup('s', LABEL_MAP)}, {known('u')}, {known('t')},
          case when upper(u) = u and lower(u) <> u then t end, u) end as label
      from (select raw, s, u, {title('u')} as t
            from (select raw, s, replace(s, '_', ' ') as u
                  from (select distinct raw, {strip('raw')} as s from ({source}))))"""


def path(e: str) -> str:
    known = f"case {e} " + " ".join(
        f"when {q(k)} then {q('/'.join(p))}" for k, p in LEAF_PATHS.items()
    )
    return f"{known} else {q(ROOT_LABEL)} || '/' || {e} end"


def parent(e: str) -> str:
    return case_lookup(e, PARENTS)


def domain(e: str) -> str:
    table = {k: p[0] for k, p in LEAF_PATHS.items()}
    return f"coalesce({case_lookup(e, table)}, {q(ROOT_LABEL)})"


def climb(e: str, levels: int) -> str:
    p = f"string_split({path(e)}, '/')"
    return f"({p})[greatest(1, len({p}) - {levels})]"


# -- mislabels --------------------------------------------------------------

def keyword_score(lowered: str, group: str) -> str:
    return "(" + " + ".join(f"contains({lowered}, {q(t)})::int" for t in KEYWORD_GROUPS[group]) + ")"


def mislabel_rows(source: str) -> str:
    """``source(row_id, text, label)`` plus ``suggested``."""
    rival = "greatest(" + ", ".join(g for g, _ in SUGGESTED_LABELS) + ")"
    first = " ".join(f"when {g} = {rival} then {q(n)}" for g, n in SUGGESTED_LABELS)
    insurer = " or ".join(f"contains(lt, {q(p)})" for p in INSURER_PHRASES)
    insurance = " or ".join(f"contains(lt, {q(p)})" for p in INSURANCE_WORDS)
    scores = ", ".join(f"{keyword_score('lt', g)} as {g}" for g in KEYWORD_GROUPS)
    return f"""
      select row_id, text, label, case
          when upper(label) = 'AUTOMOBILE' then case
            when automobile < 2 and {rival} > automobile then case {first} end
            when ({insurer}) and (finance >= 2 or {insurance}) then 'Finance' end
          when upper(label) = 'BPO' and bpo < 2 and it > bpo then 'Information-Technology'
        end as suggested
      from (select *, {scores} from (select *, lower(text) as lt from ({source})))"""
