"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends, A-Z in lower case; it is
known by a 128-bit digest.  :class:`LineIndex` holds two tables:

* ``counts`` (digest, n_docs, last_doc): the exact reference counts, one row for every
  key; ``refs`` (digest, doc_id) lists who holds it, so that a deletion can be undone
  to the row.  Rows of one id are one document; a row without id is one of its own.
* ``filters`` (shard, slots): a cuckoo filter for each shard of the keys that enough
  documents hold.  A cuckoo filter can forget a key, so a deletion takes keys out
  that fall below the limit.

Documents are read against the filters; the few lines that pass are looked up in
the exact counts, so a false positive of a filter costs a lookup and never a line.
While the filters and the counts of those keys are within a fixed size they go to
the tasks, and no text is moved.  Beyond it tasks map the filters from files, and only the lines
that pass are joined with the exact counts; what they lose goes back to the rows.
Insertions and deletions count again only the keys that they touch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.kneser_ney import Store
from textmill.llm.substrings import row_key
from textmill.llm.tables import stored
from textmill.llm.words import mix

_WHITE = b" \t\n\x0b\f\r"
#: A bucket of a filter has four slots of 16 bits; 0 is an empty slot.
_SLOTS, _KICKS = 4, 500


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the line's key; None if the key is too short."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """A set of digests with a small rate of false positives, which can forget."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.9)))))
        self.slots = np.zeros((buckets, _SLOTS), np.uint16) if slots is None else slots
        self.mask = len(self.slots) - 1

    @classmethod
    def of(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(mark, first)

    def _other(self, mark: int, place: int) -> int:
        return (place ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return bool((self.slots[one] == mark).any() or (self.slots[two] == mark).any())

    def insert(self, digest: bytes) -> bool:
        """False if there is no room: the caller builds a larger filter."""
        mark, one, two = self._places(digest)
        for place in (one, two):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = two
        for kick in range(_KICKS):
            k = kick % _SLOTS
            mark, self.slots[place, k] = int(self.slots[place, k]), mark
            place = self._other(mark, place)
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def remove(self, digest: bytes) -> None:
        """Takes one copy of an inserted digest out."""
        mark, one, two = self._places(digest)
        for place in (one, two):
            at = np.flatnonzero(self.slots[place] == mark)
            if len(at):
                self.slots[place, at[0]] = 0
                return

    @staticmethod
    def build(digests: list[bytes]) -> CuckooFilter:
        room = len(digests)
        while True:
            made = CuckooFilter(room)
            if all(made.insert(d) for d in digests):
                return made
            room = 2 * max(room, 8)


def matches(filters: dict[int, np.ndarray], shards: int, digests: np.ndarray) -> np.ndarray:
    """For each digest (rows of 16 bytes) whether its shard's filter may hold it."""
    words = digests.view("<u8").reshape(-1, 2)
    shard = (mix(words[:, 1].copy()) % np.uint64(shards)).astype(np.int64)
    mark = digests[:, :2].copy().view("<u2").ravel().astype(np.int64)
    mark[mark == 0] = 1
    low = digests[:, 2:10].copy().view("<u8").ravel()
    out = np.zeros(len(digests), bool)
    for s in np.unique(shard):
        slots = filters.get(int(s))
        if slots is None:
            continue
        at = np.flatnonzero(shard == s)
        one = (low[at] & np.uint64(len(slots) - 1)).astype(np.int64)
        two = (one ^ (mark[at] * 0x5BD1E995 >> 3)) & (len(slots) - 1)
        m = mark[at, None].astype(np.uint16)
        out[at] = (slots[one] == m).any(axis=1) | (slots[two] == m).any(axis=1)
    return out


def _sharded(shards: int):
    """Arrow task: adds the shard of the digest, the first column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8").reshape(-1, 2)
            shard = (mix(flat[:, 1].copy()) % np.uint64(shards)).astype(np.int32)
            yield pa.record_batch([*b.columns, pa.array(shard)], [*b.schema.names, "shard"])

    return run


def _keys(min_chars: int):
    """Arrow task: (doc_id, text) to the distinct keys of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, rows = [], []
            for i, text in enumerate(b.column(1)):
                if (raw := text.as_buffer() if text.is_valid else None) is None:
                    continue
                found = {line_digest(x, min_chars) for x in raw.to_pybytes().split(b"\n") if len(x) >= min_chars}
                found.discard(None)
                digests += found
                rows += [i] * len(found)
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([pa.array(digests, pa.binary()), ids], ["digest", "doc_id"])

    return run


def _filed(store: Store):
    """Arrow task: (shard, slots) to the files of the filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [store.write(np.frombuffer(x.as_buffer(), np.uint16)) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(names, pa.string())], ["shard", "name"])

    return run


def _hits(min_chars: int, shards: int, store: Store, files: list[tuple[int, str]]):
    """Arrow task: (k0, k1, own_id, text) to the different keys of each row that the filters may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = {s: np.asarray(store.map(name, np.uint16)).reshape(-1, _SLOTS) for s, name in files}
        for b in batches:
            digests, rows = [], []
            for i, text in enumerate(b.column(3)):
                if text.is_valid:
                    found = {line_digest(x, min_chars) for x in text.as_buffer().to_pybytes().split(b"\n") if len(x) >= min_chars}
                    found.discard(None)
                    digests += found
                    rows += [i] * len(found)
            flat = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
            maybe = np.flatnonzero(matches(slots, shards, flat)) if digests else np.zeros(0, np.int64)
            row = pa.array(np.array(rows, np.int64)[maybe])
            yield pa.record_batch([*[b.column(k).take(row) for k in range(3)], pa.array([digests[k] for k in maybe], pa.binary())],
                                  ["k0", "k1", "own_id", "digest"])

    return run


def _counted(refs: DataFrame) -> DataFrame:
    """(digest, n_docs, last_doc): the documents that hold each key."""
    held = refs.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    return held.groupBy("digest").agg(
        F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _filter_group(shards: int):
    """Arrow group: the cuckoo filter of one shard's digests."""
    def run(group: pa.Table) -> pa.Table:
        made = CuckooFilter.build(group["digest"].to_pylist())
        return pa.table({"shard": group["shard"][:1], "slots": pa.array([made.slots.tobytes()], pa.binary())})

    return run


def _change_filter(group: pa.Table, filters: pa.Table) -> pa.Table:
    """Arrow group: one shard's filter after keys crossed the limit, up or down."""
    shard = (group["shard"] if group.num_rows else filters["shard"])[0].as_py()
    made = CuckooFilter.of(filters["slots"][0].as_py()) if filters.num_rows else CuckooFilter(64)
    plus = [d for d, up in zip(group["digest"].to_pylist(), group["up"].to_pylist()) if up]
    for d, up in zip(group["digest"].to_pylist(), group["up"].to_pylist()):
        if not up:
            made.remove(d)
    full = not all([made.insert(d) for d in plus])
    return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([None if full else made.slots.tobytes()], pa.binary())})


def _result(rows: pa.Array, texts: list, kept: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    """``kept``: what is left of each text, its lines, and how many of them went."""
    return pa.record_batch(
        [rows, pa.array([raw if t else None for t, (raw, _, _) in zip(texts, kept)], pa.binary()).cast(pa.string()),
         pa.array([n for _, n, _ in kept], pa.int64()), pa.array([n for *_, n in kept], pa.int64()),
         pa.array([hashlib.sha256(raw).hexdigest() for raw, *_ in kept], pa.string())],
        ["row", "kept_text", "n_lines", "n_dropped", "kept_sha256"])


def _without(raw: bytes, lines: list[bytes], gone: set[int]) -> tuple[bytes, int, int]:
    if not gone:
        return raw, len(lines), 0
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def _apply_joined(min_chars: int):
    """Arrow task: (row, text, dropped digests) to the lines that stay and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for text, gone in zip(b.column(1), b.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                out = set(gone.as_py()) if gone.is_valid else ()
                kept.append(_without(raw, lines, {
                    i for i, x in enumerate(lines) if out and len(x) >= min_chars and line_digest(x, min_chars) in out}))
            yield _result(b.column(0), [t.is_valid for t in b.column(1)], kept)

    return run


def _apply_here(min_chars: int, shards: int, shared):
    """Arrow task: (row, text, own_id) to the lines that stay and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, exact, last_doc = shared.value
        slots = {s: np.frombuffer(x, np.uint16).reshape(-1, _SLOTS) for s, x in filters.items()}
        for b in batches:
            raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(1)]
            split = [raw.split(b"\n") for raw in raws]
            spots = [(r, i, d) for r, lines in enumerate(split) for i, x in enumerate(lines)
                     if len(x) >= min_chars and (d := line_digest(x, min_chars)) is not None]
            gone: dict[int, set[int]] = {}
            if spots and len(exact):
                flat = np.frombuffer(b"".join([d for *_, d in spots]), np.uint8).reshape(-1, 16)
                maybe = np.flatnonzero(matches(slots, shards, flat))
                digests = flat[maybe].copy().view("V16").ravel()
                at = np.minimum(np.searchsorted(exact, digests.view("S16")), len(exact) - 1) if len(maybe) else maybe
                found = maybe[exact[at].view("V16") == digests] if len(maybe) else maybe
                last = last_doc[at[exact[at].view("V16") == digests]] if len(maybe) else maybe
                ids = b.column(2)
                for k, most in zip(found.tolist(), last.tolist()):
                    r, i, _ = spots[k]
                    if not ids[r].is_valid or ids[r].as_py() < most:
                        gone.setdefault(r, set()).add(i)
            yield _result(b.column(0), [t.is_valid for t in b.column(1)],
                          [_without(raw, lines, gone.get(r, set())) for r, (raw, lines) in enumerate(zip(raws, split))])

    return run


@dataclass(frozen=True)
class LineIndex:
    """Who holds which line.  ``add`` and ``remove`` give a new index; tables are stored."""

    counts: DataFrame
    refs: DataFrame | None
    filters: DataFrame
    shards: int
    min_chars: int = 40
    min_docs: int = 5
    #: Filters and counts of more bytes than this are not sent to the tasks, but joined.
    sent_bytes: int = 32 << 20

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
              keep_refs: bool = True, shard_keys: int = 1 << 16) -> LineIndex:
        """The index of a table.  Rows of one id are one document, each row without id is one.

        Without ``keep_refs`` the table of holders is not stored, and nothing can be
        added or removed later.
        """
        keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _keys(min_chars), "digest binary, doc_id long")
        refs = stored(keys, "refs") if keep_refs else None
        counts = stored(_counted(refs if keep_refs else keys).filter(F.lit(keep_refs) | (F.col("n_docs") >= min_docs)), "counts")
        often = counts.filter(F.col("n_docs") >= min_docs)
        shards = 1 + often.count() // shard_keys
        filters = stored(often.select("digest").mapInArrow(
            _sharded(shards), "digest binary, shard int").groupBy("shard").applyInArrow(
            _filter_group(shards), "shard int, slots binary"), "filters")
        return LineIndex(counts, refs, filters, shards, min_chars, min_docs)

    def _after(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index with other holders, which differ in the touched keys only."""
        touched = stored(touched.select("digest").distinct(), "touched")
        new = stored(_counted(refs.join(touched, "digest", "left_semi")), "counts")
        counts = self.counts.join(touched, "digest", "left_anti").select("digest", "n_docs", "last_doc").union(new)
        was = self.counts.join(touched, "digest", "left_semi").filter(F.col("n_docs") >= self.min_docs).select(
            "digest", F.lit(True).alias("was"))
        now = new.filter(F.col("n_docs") >= self.min_docs).select("digest", F.lit(True).alias("now"))
        shards = self.shards
        changed = was.join(now, "digest", "full").filter("was is null or now is null").select(
            "digest", F.col("now").isNotNull().alias("up")).mapInArrow(
            _sharded(shards), "digest binary, up boolean, shard int")
        filters = stored(changed.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(
            _change_filter, "shard int, slots binary"), "filters")
        full = filters.filter("slots is null").select("shard")
        if not full.isEmpty():  # these shards outgrew their filters
            again = counts.filter(F.col("n_docs") >= self.min_docs).select("digest").mapInArrow(
                _sharded(shards), "digest binary, shard int").join(full, "shard", "left_semi").groupBy(
                "shard").applyInArrow(_filter_group(shards), "shard int, slots binary")
            filters = stored(filters.filter("slots is not null").union(again), "filters")
        return LineIndex(counts, refs, filters, shards, self.min_chars, self.min_docs, self.sent_bytes)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _keys(self.min_chars), "digest binary, doc_id long")
        added = stored(keys, "refs")
        return self._after(self._held().union(added), added)

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of the ids (doc_id)."""
        gone = doc_ids.select("doc_id").distinct()
        return self._after(self._held().join(gone, "doc_id", "left_anti").select("digest", "doc_id"),
                           self._held().join(gone, "doc_id", "left_semi"))

    def _held(self) -> DataFrame:
        if self.refs is None:
            raise ValueError("this index was built without keep_refs, so nothing can be added or removed")
        return self.refs

    def compacted(self) -> LineIndex:
        """The same index with its tables written anew, which ends the chain of earlier changes."""
        return replace(self, counts=stored(self.counts, "counts"), refs=stored(self._held(), "refs"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(row, kept_text, n_lines, n_dropped, kept_sha256); ``row`` is the row of ``docs`` as it came.

        A key that enough documents hold stays in the document of the largest id
        only.  A null or empty text is one empty line; a null stays null.  A row
        without id loses such lines if some holder has an id.
        """
        spark = docs.sparkSession
        often = self.counts.filter((F.col("n_docs") >= self.min_docs) & F.col("last_doc").isNotNull())
        wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("own_id"))
        schema = f"row {wide.schema['row'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long, kept_sha256 string"
        size = (self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0) + 24 * often.count()
        if size <= self.sent_bytes:
            exact = sorted((bytes(r["digest"]), r["last_doc"]) for r in often.select("digest", "last_doc").collect())
            shared = spark.sparkContext.broadcast((
                {r["shard"]: bytes(r["slots"]) for r in self.filters.collect()},
                np.frombuffer(b"".join(d for d, _ in exact), "S16"), np.array([n for _, n in exact], np.int64)))
            return wide.mapInArrow(_apply_here(self.min_chars, self.shards, shared), schema)
        store = Store.new(spark, "line-filters")
        files = [tuple(r) for r in self.filters.select("shard", "slots").mapInArrow(_filed(store), "shard int, name string").collect()]
        rows = wide.select("row", "text", "own_id", *row_key(F.col("own_id"), F.col("text")))
        hits = rows.select("k0", "k1", "own_id", "text").mapInArrow(
            _hits(self.min_chars, self.shards, store, files), "k0 long, k1 long, own_id long, digest binary")
        dropped = stored(hits.join(often, "digest").filter("own_id is null or own_id < last_doc").groupBy("k0", "k1").agg(
            F.collect_set("digest").alias("dropped")), "dropped")
        joined = rows.join(dropped, ["k0", "k1"], "left").select("row", "text", "dropped")
        return joined.mapInArrow(_apply_joined(self.min_chars), schema)
