"""Small helpers shared by the column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst inlines an expression wherever it is named, so an array that is
    used five times would be built five times.  A lambda argument is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def string_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def lookup(entries: Mapping[str, str], key: Column) -> Column:
    """Constant-table lookup, null when the key is absent."""
    return F.try_element_at(string_map(entries), key)


def hash_hex(*parts: Column | str | int) -> Column:
    """32 hex digits from the parts; equal under any engine and partitioning.

    Strings and numbers stand for themselves, not for columns.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_int(*parts: Column | str | int) -> Column:
    """The first 32 bits of :func:`hash_hex` as a non-negative long."""
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("long")
