"""Removal of every long byte string that occurs more than once.

A string of ``length`` bytes (a window) is repeated if it also starts anywhere else, in
the same text or in another.  Suffix arrays tell: the suffixes that begin with equal
windows are neighbours.  To build them apart from each other, windows are sorted into
anchors: the smallest hash of the ``gram``-byte runs in a window.  Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so a text is a row of
*pieces*, each the bytes of the windows with one anchor.

Anchors that occur once go first, as 64-bit numbers.  Equal pieces of an anchor
collapse and repeat all their windows.  Where an anchor has several different pieces, or
one that may repeat itself, the bytes of one occurrence of each are sent to a task by the hash of the anchor, and
the suffix array of all pieces of that task (:mod:`grouping`) decides their windows;
only pieces without any two windows of equal hash are left out of it.  An anchor
whose pieces are too many bytes for one task is decided by 128-bit digests of its
windows, spread over the tasks.  Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.grouping import suffix_array
from textmill.llm.tables import stored
from textmill.llm.words import mix, signed, slices, text_bytes

#: A piece has at most so many windows; a longer run of one anchor is several pieces.
_LONGEST = 4096
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` values in a row, of twice as many from two halves."""
    size, odd = 1, 0x9E3779B97F4A7C15
    while size < n:
        step = min(size, n - size)
        h = h[:-step] * np.uint64(odd) + h[step:]
        odd = odd * odd % (1 << 64)
        size += step
    return mix(h)


def _lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` values in a row."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def pieces(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, start in it, number of windows and anchor of every piece of the texts ``raw[at[i]:at[i + 1]]``,
    and whether windows in it may be equal: then the anchor is at several places, so not in the last window alone."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if len(raw) < length:
        return none
    grams = _runs(_BYTE[raw], gram)
    anchor = _lowest(grams, length - gram + 1)
    inside, new = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # no window goes on into the next text
        inside[max(a, b - length + 1):b] = False
        new[a:a + 1] = True
    begin = np.flatnonzero(new & inside)
    if not len(begin):
        return none
    text = np.searchsorted(at, begin, "right") - 1
    n = np.minimum(np.append(begin[1:], len(anchor)), at[text + 1] - length + 1) - begin
    twice = (n > 1) & (np.minimum.reduceat(grams, np.stack([begin, begin + n - 1], axis=1).ravel())[::2] == anchor[begin])
    parts = -(-n // _LONGEST)
    start, text = np.repeat(begin - at[text], parts), np.repeat(text, parts)
    k = np.arange(len(start)) - np.repeat(np.cumsum(parts) - parts, parts)
    n = np.minimum(np.repeat(n, parts) - k * _LONGEST, _LONGEST)
    return text, start + k * _LONGEST, n, np.repeat(anchor[begin], parts), np.repeat(twice, parts)


_PIECE = "anchor long, piece long, k0 long, k1 long, start int, windows int, twice boolean"


def _anchored(length: int, gram: int, anchors_only: bool):
    """Arrow task: (k0, k1, text) to the pieces of each text, or just their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, at = text_bytes(b.column(2))
            text, start, n, anchor, twice = pieces(raw, at, length, gram)
            if anchors_only:
                yield pa.record_batch([pa.array(signed(np.repeat(anchor, 1 + twice)))], ["anchor"])
                continue
            data = memoryview(np.ascontiguousarray(raw))
            begin = start + at[text]
            digest = [xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(begin.tolist(), (begin + n + length - 1).tolist())]
            row = pa.array(text)
            yield pa.record_batch(
                [pa.array(signed(anchor)), pa.array(signed(np.array(digest, np.uint64))), b.column(0).take(row), b.column(1).take(row),
                 pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(twice)], [c.split()[0] for c in _PIECE.split(", ")])

    return run


def _bytes_of(length: int):
    """Arrow task: (text, wanted) to the bytes of the wanted pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                wanted = b.column(1)
                each = wanted.flatten()
                text = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
                raws = [x.as_buffer().to_pybytes() for x in b.column(0)]
                start, n = each.field("start").to_numpy(), each.field("windows").to_numpy()
                data = [raws[t][s:s + w + length - 1] for t, s, w in zip(text.tolist(), start.tolist(), n.tolist())]
                yield pa.record_batch([*[each.field(c) for c in ("anchor", "piece", "windows", "alone", "wide")], pa.array(data, pa.binary())],
                                      ["anchor", "piece", "windows", "alone", "wide", "data"])

    return run


def repeated_windows(data: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts of its windows that occur again in any of the pieces, by their suffix array."""
    n, size = len(data), np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    raw = np.frombuffer(b"\0".join(data) + b"\0" * 8, np.uint8)
    symbols = raw[:ends[-1] + 1].astype(np.int32) + n
    symbols[ends] = np.arange(n - 1, -1, -1)  # each end is a symbol of its own, and the last one the smallest
    order = suffix_array(symbols)
    left = np.repeat(ends, size + 1) - np.arange(ends[-1] + 1)
    order = order[left[order] >= length]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    a, b, same = order[:-1], order[1:], np.ones(max(len(order) - 1, 0), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = eight[a[at] + k] == eight[b[at] + k]
    hit = np.zeros(ends[-1] + 1, bool)
    hit[a[same]] = hit[b[same]] = True
    return [np.flatnonzero(hit[x:y]) for x, y in zip(begins, ends)]


def may_repeat(data: list[bytes], length: int) -> np.ndarray:
    """The pieces that have a window whose hash two windows have; no other holds a repeated window."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    h = _runs(_BYTE[np.frombuffer(b"".join(data), np.uint8)], length)
    piece = np.repeat(np.arange(len(data), dtype=np.int32), np.diff(at))[:len(h)]
    own = np.flatnonzero(np.arange(len(h)) + length <= at[piece + 1])
    h, piece = h[own], piece[own]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(piece[np.concatenate([order[1:][same], order[:-1][same]])])


def _spans(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of neighbouring numbers begin and end."""
    new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + 1).tolist()


_DECIDED = "anchor long, piece long, windows int, low array<int>, high array<int>"


def _decided(length: int):
    """Arrow group: the pieces of some anchors to the runs of repeated windows of those that occur once."""
    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(may_repeat(group["data"].to_pylist(), length)))
        found = repeated_windows(group["data"].to_pylist(), length) if group.num_rows else []
        rows = [i for i, (x, alone) in enumerate(zip(found, group["alone"].to_pylist())) if alone and len(x)]
        spans = [_spans(found[i]) for i in rows]
        took = group.select(["anchor", "piece", "windows"]).take(pa.array(rows, pa.int64()))
        return pa.table([*took.columns, pa.array([s for s, _ in spans], pa.list_(pa.int32())),
                         pa.array([e for _, e in spans], pa.list_(pa.int32()))], ["anchor", "piece", "windows", "low", "high"])

    return run


def _windows_of(length: int):
    """Arrow task: pieces to the digests of all their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            n = b.column(2).to_numpy()
            row = pa.array(np.repeat(np.arange(b.num_rows), n))
            digest = [xxhash.xxh3_128_digest(x[k:k + length]) for x, m in zip(b.column(4).to_pylist(), n.tolist()) for k in range(m)]
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch([*[b.column(k).take(row) for k in range(4)], pa.array(at, pa.int32()), pa.array(digest, pa.binary())],
                                  ["anchor", "piece", "windows", "alone", "at", "window"])

    return run


def _by_digests(wide: DataFrame, length: int) -> DataFrame:
    """What :func:`_decided` gives, for pieces of anchors that are too many for one task."""
    windows = stored(wide.select("anchor", "piece", "windows", "alone", "data").mapInArrow(
        _windows_of(length), "anchor long, piece long, windows int, alone boolean, at int, window binary"), "windows")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    return windows.filter("alone").join(again, "window", "left_semi").groupBy("anchor", "piece", "windows").agg(
        F.sort_array(F.collect_list("at")).alias("low")).select(
        "anchor", "piece", "windows", "low", F.transform("low", lambda x: x + 1).alias("high"))


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: (row, text, covered) to what is left of the bytes, and the spans that went."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            b = batch.slice(k, 64)
            raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            kept, spans = [], []
            for raw, covered in zip(raws, b.column(2)):
                gone = []
                if covered.is_valid:
                    low, high = (covered.values.field(c).to_numpy() for c in ("low", "high"))
                    order = np.argsort(low, kind="stable")
                    low, high = low[order], np.maximum.accumulate(high[order])
                    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                    gone = list(zip(low[new].tolist(), high[np.append(new[1:], len(low)) - 1].tolist()))
                cuts = [0, *[x for span in gone for x in span], len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])) if gone else raw)
                spans.append([{"begin": x, "end": y} for x, y in gone])
            yield pa.record_batch([b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(spans, kind),
                                   pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])


def covered_bytes(texts: DataFrame, length: int = 200, gram: int = 32, task_bytes: int = 1 << 20, anchor_bytes: int = 2 << 20) -> DataFrame:
    """(k0, k1, covered): the ranges (low, high) of bytes in repeated windows, of the rows (k0, k1, text) that have any.

    Each row is a text.  Rows of one (k0, k1) must have one text.  A task orders some
    ``task_bytes`` of pieces, and ``anchor_bytes`` of one anchor at most.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    texts = texts.select("k0", "k1", "text")
    shared = stored(texts.mapInArrow(_anchored(length, gram, True), "anchor long").groupBy("anchor").agg(
        F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    live = stored(texts.mapInArrow(_anchored(length, gram, False), _PIECE).join(shared, "anchor", "left_semi"), "pieces")
    one = ["anchor", "piece", "windows"]
    kinds = stored(live.groupBy(*one).agg(F.count("*").alias("n"), F.min(F.struct("k0", "k1", "start")).alias("at"),
        F.max("twice").alias("twice")), "kinds")
    several = kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.max("twice").alias("twice"), F.min("n").alias("least"),
        F.sum(F.col("windows") + length).alias("bytes")).filter("least = 1 and (kinds > 1 or twice)").select(
        "anchor", (F.col("bytes") > anchor_bytes).alias("wide"))
    open_ = kinds.join(several, "anchor").select("at.*", *one, (F.col("n") == 1).alias("alone"), "wide")
    wanted = open_.groupBy("k0", "k1").agg(F.collect_list(F.struct("anchor", "piece", "start", "windows", "alone", "wide")).alias("wanted"))
    # Rows of one key give the same pieces; one of each goes on.
    bytes_ = stored(texts.join(wanted, ["k0", "k1"]).select("text", "wanted").mapInArrow(
        _bytes_of(length), "anchor long, piece long, windows int, alone boolean, wide boolean, data binary").dropDuplicates(one), "bytes")
    total = bytes_.filter(~F.col("wide")).agg(F.sum(F.length("data"))).first()[0] or 0
    found = bytes_.filter(~F.col("wide")).select(
        F.pmod(F.xxhash64("anchor"), F.lit(1 + total // task_bytes)).alias("task"), *one, "alone", "data").groupBy("task").applyInArrow(
        _decided(length), _DECIDED)
    whole = kinds.filter("n > 1").select(*one, F.array(F.lit(0)).alias("low"), F.array("windows").alias("high"))
    repeated = stored(whole.union(found).union(_by_digests(bytes_.filter("wide"), length)), "repeated")
    ranges = live.join(repeated, one).select("k0", "k1", "start", F.explode(F.arrays_zip("low", "high")).alias("x")).select(
        "k0", "k1", (F.col("start") + F.col("x.low")).alias("low"), (F.col("start") + F.col("x.high") + length - 1).alias("high"))
    return ranges.groupBy("k0", "k1").agg(F.collect_set(F.struct("low", "high")).alias("covered"))


def row_key(id_col: Column, text: Column) -> list[Column]:
    """128 bits that name an id and a text; null differs from every value."""
    return [F.xxhash64(F.lit("row"), id_col.isNull(), id_col, text).alias("k0"), F.xxhash64(text).alias("k1")]


def without_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32,
                                task_bytes: int = 1 << 20, anchor_bytes: int = 2 << 20) -> DataFrame:
    """(row, n_bytes, spans, kept) for every row; ``row`` is the row as it came.

    Bytes of the UTF-8 text that a repeated window covers go; ``spans`` (begin, end) are
    the maximal runs of them, ``kept`` the other bytes, which need not be UTF-8 any more.
    A null text is empty.  Each row is a text: repeated rows repeat each other, and rows
    without id are rows like others.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "row", "text", *row_key(F.col("id"), F.col("text")))
    covered = covered_bytes(rows, length, gram, task_bytes, anchor_bytes)
    wide = rows.join(covered, ["k0", "k1"], "left").select("row", "text", "covered")
    return wide.mapInArrow(_removing, (
        f"row {wide.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary"))
