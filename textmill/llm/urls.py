"""URL filter with dated lists: an as-of join.

A list is a table of dated entries that add or remove a pattern: a domain, which
stands for its subdomains as well, or a host with the beginning of a path.  Entries
become validity intervals, and a capture is listed if one of the patterns that its
URL falls under was valid when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; null if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def url_patterns(url: Column) -> Column:
    """All patterns that a URL falls under: each ending of its host at a dot, and the host with each beginning of its path."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.array_remove(F.split(path, "/"), "")
    paths = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) of dated entries (pattern, action, at); ``valid_to`` is null while it lasts.

    The state changes with the last entry of a time; of several at one time an
    ``add`` counts.  Entries without pattern or time, or with another action than
    ``add`` and ``remove``, say nothing.  Repeated entries count once.
    """
    at_once = entries.filter("pattern is not null and at is not null and action in ('add', 'remove')").groupBy(
        "pattern", "at").agg(F.max(F.col("action") == "add").alias("valid"))
    order = Window.partitionBy("pattern").orderBy("at")
    changes = at_once.withColumn("was", F.lag("valid").over(order)).filter(
        F.col("valid") != F.coalesce("was", F.lit(False)))
    return changes.withColumn("valid_to", F.lead("at").over(order)).filter("valid").select(
        "pattern", F.col("at").alias("valid_from"), "valid_to")


def listed_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    time_col: str = "fetched_at") -> DataFrame:
    """(id, url, time, n_rows, listed, n_patterns, pattern, valid_from): one row for each different capture.

    ``pattern`` is the longest that was valid at the time (of equal length the first
    by name).  A capture without URL, host or time is not listed.  ``n_rows`` is how
    often the capture occurs.  The capture's patterns meet the intervals in an
    equi-join on the pattern, whose hot hosts the adaptive planner splits; what
    leaves it is one partial maximum for a capture and task.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("time")).groupBy(
        "id", "url", "time").agg(F.count("*").alias("n_rows"))
    wide = rows.select("*", F.explode_outer(url_patterns(F.col("url"))).alias("pattern"))
    valid = validity_intervals(entries)
    met = wide.join(valid, (wide["pattern"] == valid["pattern"]) & (wide["time"] >= valid["valid_from"])
                    & (valid["valid_to"].isNull() | (wide["time"] < valid["valid_to"])), "left").select(
        "id", "url", "time", "n_rows", valid["pattern"].alias("pattern"), "valid_from")
    best = F.min(F.when(F.col("pattern").isNotNull(), F.struct(
        (-F.length("pattern")).alias("longest"), F.col("pattern").alias("pattern"), F.col("valid_from").alias("valid_from"))))
    return met.groupBy("id", "url", "time").agg(
        F.max("n_rows").alias("n_rows"), F.count("pattern").alias("n_patterns"), best.alias("best")).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("time").alias(time_col), "n_rows",
        (F.col("n_patterns") > 0).alias("listed"), "n_patterns", F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("valid_from"))
