"""Passages that repeat across documents: MinHash banding of paragraphs.

A paragraph is a line of a text with enough words.  Paragraphs of equal words
collapse first; the others meet in the buckets of their bands, which are tuned for a
recall at the threshold, are compared by the exact Jaccard similarity of their word
shingles, and form clusters by connected components.  In a cluster that spans
several documents the first paragraph (smallest document id, then place) stays.

Passages that lines do not bound are found by their runs of words, whatever lines
these are on: every run of ``length`` words that several documents hold is found,
and runs that overlap are one passage.  To meet, runs need not be counted all: a run
is named by the smallest hash of its shorter runs, and only those whose name several
documents hold go on (winnowing, without loss).  A bitmap of these names, which all tasks
get, keeps most others out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.minhash import SIGNED, Banding, crowded_buckets, near_links, shingles, signed_columns
from textmill.llm.tables import stored
from textmill.llm.words import mix, signed, slices, text_bytes, word_hashes, word_spans

RECALL = 0.999


def _split(texts: pa.Array, min_words: int) -> tuple:
    """Row, place, number of words and text of each paragraph; word hashes and word
    bounds of all lines, and which of these are paragraphs."""
    lines, row, place = [], [], []
    for i, text in enumerate(texts):
        if text.is_valid:
            parts = text.as_buffer().to_pybytes().split(b"\n")
            for k, line in enumerate(parts):
                if len(line) >= 2 * min_words - 1:
                    lines.append(line)
                    row.append(i)
                    place.append(k)
    column = pa.array(lines, pa.binary()).cast(pa.string())
    h, before = word_hashes(column)
    n = np.diff(before)
    keep = np.flatnonzero(n >= min_words)
    return np.array(row, np.int64)[keep], np.array(place, np.int64)[keep], n[keep], column.take(pa.array(keep)), h, before, keep


def _occurrences(width: int, banding: Banding, min_words: int):
    """Arrow task: (doc_id, text) to its paragraphs with size, digest, bands and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            row, place, n, _, h, before, keep = _split(b.column(1), min_words)
            sets = shingles(h, before, width, keep)
            yield pa.record_batch(
                [b.column(0).take(pa.array(row)), pa.array(place), pa.array(n), *signed_columns(sets, banding)],
                ["doc_id", "para", "n_words", "n", "digest", "bands", "sketch"])

    return run


def _spot(doc_id: np.ndarray, para: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + para.astype(np.int64).view(np.uint64))


def _texts(min_words: int, wanted):
    """Arrow task: (doc_id, text) to place and text of its paragraphs, if their hashed places are ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            row, place, _, lines, *_rest = _split(b.column(1), min_words)
            out = pa.record_batch([b.column(0).take(pa.array(row)), pa.array(place), lines], ["doc_id", "para", "text"])
            if wanted is not None and out.num_rows:
                spots, known = _spot(out.column(0).to_numpy(), place), wanted.value
                at = np.minimum(np.searchsorted(known, spots), max(len(known) - 1, 0))
                out = out.filter(pa.array(known[at] == spots if len(known) else np.zeros(len(spots), bool)))
            yield out

    return run


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 40, width: int = 5,
                        threshold: int = 75, banding: Banding | None = None, sent_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, para, n_words, keeper_doc_id, keeper_para, removed): the paragraphs of clusters in several documents.

    ``para`` is the number of the line, from 0.  Rows without id or text have no
    paragraph, nor have texts without a line of ``min_words`` words; repeated rows
    with one id are one document and keep their own rows.  While the places of the
    paragraphs that share a bucket take at most ``sent_bytes``, they are sent to the
    tasks, which then pass on those paragraphs alone.
    """
    banding = banding or Banding.tuned(threshold, RECALL, 48, 512)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    found = texts.mapInArrow(_occurrences(width, banding, min_words), f"doc_id long, para long, n_words long, {SIGNED}")
    classes = found.groupBy("digest").agg(
        F.min(F.struct("doc_id", "para")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"))
    # The table is stored, so the numbers that it gets stay the same; they name its rows in what follows.
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = crowded_buckets(nodes)
    crowded = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.para")
    wanted = None
    if 8 * crowded.count() <= sent_bytes:  # else all paragraphs go through the join
        places = crowded.select("doc_id", "para").toPandas()
        wanted = docs.sparkSession.sparkContext.broadcast(
            np.sort(_spot(places["doc_id"].to_numpy(np.int64), places["para"].to_numpy(np.int64))))
    lines = texts.mapInArrow(_texts(min_words, wanted), "doc_id long, para long, text string")
    named = stored(lines.join(crowded, ["doc_id", "para"]).select("node", "text"), "paragraphs")
    near = near_links(nodes, buckets, named, width, threshold, banding)
    cluster = nodes.select("digest", "node").join(near, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    members = stored(texts.mapInArrow(
        _digests(width, min_words), "doc_id long, para long, n_words long, digest binary").join(
        cluster, "digest").drop("digest"), "members")
    wide = members.groupBy("component").agg(
        F.min(F.struct("doc_id", "para")).alias("keeper"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    return members.join(wide, "component").select(
        "doc_id", "para", "n_words", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.para").alias("keeper_para"),
        (F.struct("doc_id", "para") != F.col("keeper")).alias("removed"))


def _digests(width: int, min_words: int):
    """Arrow task: (doc_id, text) to its paragraphs with the digests of their sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            row, place, n, _, h, before, keep = _split(b.column(1), min_words)
            sets = shingles(h, before, width, keep)
            yield pa.record_batch(
                [b.column(0).take(pa.array(row)), pa.array(place), pa.array(n),
                 pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())],
                ["doc_id", "para", "n_words", "digest"])

    return run


def _cut(raw: bytes, lines: set[int], ranges: list[tuple[int, int]]) -> bytes:
    """The text without some lines, and without the bytes from the first to the last word of some ranges of words."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    gone = np.zeros(len(data) + 1, bool)
    for first, last in ranges:
        gone[start[first]:end[last - 1]] = True
    out, at, joined = [], 0, True
    for k, line in enumerate(raw.split(b"\n")):
        if k not in lines:
            out.append((b"" if joined else b"\n") + bytes(data[at:at + len(line)][~gone[at:at + len(line)]]))
            joined = False
        joined = joined or bool(gone[at + len(line)])  # a range that goes on over the line's end takes it along
        at += len(line) + 1
    return b"".join(out)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: (row, text, gone) to the row and what is left of the text."""
    for b in batches:
        texts = []
        for text, gone in zip(b.column(1), b.column(2)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else None
            if raw is not None and gone.is_valid:
                spans = gone.as_py()
                raw = _cut(raw, {g["para"] for g in spans if g["start"] is None},
                           [(g["start"], g["start"] + g["n_words"]) for g in spans if g["start"] is not None])
            texts.append(raw)
        yield pa.record_batch([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "text"])


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what was removed taken out of the text: whole lines of the rows of
    ``repeats`` without ``start`` (or all, if it has no such column), and of the others their words, with what stands between them.

    Rows without id, and null and empty texts, stay as they are; the rows of an id are cut alike.
    """
    start = F.col("start") if "start" in repeats.columns else F.lit(None).cast("long").alias("start")
    gone = repeats.filter("removed").groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.collect_set(F.struct("para", start, "n_words")).alias("gone"))
    wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("own_id")).join(
        gone, F.col("own_id") == F.col("gone_id"), "left").select("row", "text", "gone")
    cut = wide.mapInArrow(_cutting, f"row {wide.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


# -- passages ---------------------------------------------------------------------

def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row; of twice as many from two halves, so log n steps."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        h = mix(h[:-step] * np.uint64(5) ^ h[step:])
        size += step
    return h


def _lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` numbers in a row, in log n steps."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def _windows(h: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first word and anchor of every run of ``length`` words of one text, and which
    run begins a piece: runs in a row with one anchor.

    The anchor is the smallest hash of the run's shorter runs; equal runs have equal
    anchors, and neighbouring runs mostly share theirs.
    """
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = length // 2 + 1
    anchor = _lowest(_runs(h, short), length - short + 1)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))[:len(anchor)]
    at = np.flatnonzero(np.arange(length, length + len(anchor)) <= before[row + 1])
    row, anchor = row[at], anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    return row, at, anchor, np.flatnonzero(new)


def _anchors(length: int):
    """Arrow task: (doc_id, text) to the different anchors of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, _, anchor, new = _windows(*word_hashes(b.column(1)), length)
            yield pa.record_batch([pa.array(signed(anchor[new])), b.column(0).take(pa.array(row[new]))], ["anchor", "doc_id"])

    return run


def _sieve(anchors: DataFrame, most_bits: int = 27) -> tuple[np.ndarray, bool]:
    """The last bits of the anchors as a bitmap, and whether it has 32 or more bits for each: it takes 16 MB at most.
    It never misses an anchor, and with that many bits lets one in 32 of the others pass at most."""
    wanted = max(6, (32 * anchors.count()).bit_length())
    bits = min(most_bits, wanted)
    spot = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    found = anchors.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out, bits == wanted


def _passes(anchor: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    spot = anchor & np.uint64(64 * len(sieve) - 1)
    return (sieve[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def _anchored(length: int, shared):
    """Arrow task: (doc_id, text) to its runs, those in a row with one anchor together, if the sieve lets it pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(1)
            h, before = word_hashes(texts)
            row, at, anchor, new = _windows(h, before, length)
            go, size = _passes(anchor[new], shared.value), np.diff(new, append=len(at))
            if not go.any():
                continue
            some = np.repeat(go, size)
            raw, begins = text_bytes(texts)
            start, breaks = word_spans(raw, begins)[0], np.flatnonzero(raw == 10)
            line = np.searchsorted(breaks, start[at[some]]) - np.searchsorted(breaks, begins[row[some]])
            whole, first = _runs(h, length)[at[some]], new[go]
            cuts = pa.array(np.concatenate([[0], np.cumsum(size[go])]), pa.int32())
            yield pa.record_batch(
                [pa.array(signed(anchor[first])), b.column(0).take(pa.array(row[first])), pa.array(at[first] - before[row[first]]),
                 pa.ListArray.from_arrays(cuts, pa.array(signed(whole))), pa.ListArray.from_arrays(cuts, pa.array(line))],
                ["anchor", "doc_id", "start", "hash", "para"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, para, n_words, keeper_doc_id, keeper_para, removed, start, keeper_start): the passages of several documents.

    ``start`` is the number of the first word in the text, from 0, and ``para`` that
    of its line.  Each run of ``length`` words that two or more documents hold stays
    in its first place (smallest document id, then place); the runs of a document
    that overlap or touch and stay in the same other document are one passage, which
    may be put together from several places there (the first is given).  Rows
    without id or text have no passage; rows with one id are one document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    crowded = stored(texts.mapInArrow(_anchors(length), "anchor long, doc_id long").groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"), "anchors")
    sieve, fine = _sieve(crowded)
    packed = texts.mapInArrow(
        _anchored(length, docs.sparkSession.sparkContext.broadcast(sieve)), "anchor long, doc_id long, start long, hash array<long>, para array<long>")
    if not fine:  # many would pass
        packed = packed.join(crowded, "anchor", "left_semi")
    # Runs that the sieve let pass alone have no keeper below.
    packed = stored(packed.drop("anchor"), "runs")
    runs = packed.select("doc_id", "start", F.posexplode(F.arrays_zip("hash", "para"))).select(
        "doc_id", (F.col("start") + F.col("pos")).alias("start"), "col.hash", "col.para")
    keepers = stored(runs.groupBy("hash").agg(
        F.min(F.struct("doc_id", "start", "para")).alias("keeper"), F.max("doc_id").alias("high")).filter(
        "keeper.doc_id < high").select("hash", *[F.col(f"keeper.{c}").alias(f"keeper_{c}") for c in ("doc_id", "start", "para")]), "keepers")
    met = runs.join(keepers, "hash").drop("hash").withColumn(
        "removed", (F.col("doc_id") != F.col("keeper_doc_id")) | (F.col("start") != F.col("keeper_start")))
    one = ["doc_id", "keeper_doc_id", "removed"]
    order = Window.partitionBy(*one).orderBy("start")
    new = F.coalesce(F.col("start") > F.lag("start").over(order) + length, F.lit(True)).cast("long")
    passages = met.withColumn("new", new).withColumn("passage", F.sum("new").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return passages.groupBy(*one, "passage").agg(
        F.min(F.struct("start", "para", "keeper_start", "keeper_para")).alias("first"), F.max("start").alias("last")).select(
        "doc_id", F.col("first.para").alias("para"), (F.col("last") + length - F.col("first.start")).alias("n_words"),
        "keeper_doc_id", F.col("first.keeper_para").alias("keeper_para"), "removed", F.col("first.start").alias("start"),
        F.col("first.keeper_start").alias("keeper_start"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The near copies among paragraphs (``start`` and ``keeper_start`` are null: the whole line), and the repeated passages."""
    lines = repeated_paragraphs(docs, id_col, text_col).select(
        "*", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("keeper_start"))
    return lines.union(repeated_passages(docs, id_col, text_col))
