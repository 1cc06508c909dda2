"""Interpolated modified Kneser-Ney model of word pairs or triples.

Spark counts; the model is sorted arrays of hashes with the counts beside them, in
files that the scoring tasks map into memory.  All counting is the same job: a task
adds up what it reads and sends each shard sorted arrays of keys and the columns
beside them; a shard merges what it gets, array by array.  Keys are hashed, so the
shards are even whatever word is frequent.

Words are counted first.  A word's number is its place among the sorted hashes of
all words; a pair's key is a reversible hash of the two numbers, so no two pairs
share a key.  These hashes have just the bits that the numbers need, so neighbours
among sorted keys are close: the shuffle holds their differences, and a file 32 bits
of each key, in blocks whose beginnings give the other bits.

The probability of w after u is ``(c(uw) - D(c(uw))) / c(u) + g(u) p(w)`` with p(w)
from the number of different words before w, ``(n(w) - D(n(w))) / n + g p0``, and p0
the uniform one over the known words and one unknown.  The discounts D follow from
how many keys were counted once to four times.

With order 3, triples keep their counts, ``p(w|tu)`` discounts these in the same way,
and pairs count the different words before them instead.  A triple's key is a hash of
its pair's place among all pairs and of its last word, so it is reversible as well.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.words import slices, word_hashes
from textmill.session import new_dir

#: Hash of the mark after a text's last word.
END = np.uint64(0xE6D)
#: Numbers of the mark before a text, and of a word that was not counted; words follow.
BEGIN, UNKNOWN, FIRST = np.uint64(0), np.uint64(1), 2
#: A task sends on what it has counted when it holds this many keys, and reads stored keys by so many.
_GATHER, _BLOCK = 1_000_000, 200_000
#: Keys asked for in a block from which on a block is searched by itself.
_MANY = 50
#: kind: which of several sums travel.
SENT = "shard int, kind int, sums binary"


# -- sums of keys ---------------------------------------------------------------

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """Spreads numbers below 2**bits evenly over these, one to one."""
    half, mask = np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    for odd in _ODD:
        x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
    return x ^ (x >> half)


def unscramble(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``scramble``."""
    half, mask = np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    x = x ^ (x >> half)
    for odd in reversed(_ODD):
        x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
        x = x ^ (x >> half)
    return x


def bits_for(numbers: int) -> int:
    return max(1, (numbers - 1).bit_length())


def added(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys, sorted, and the sum of each column."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(c[order], first) for c in columns]


def packed(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted keys, as differences, and columns; the bytes of equal weight side by
    side, so that the zeros among them vanish when Spark compresses the shuffle."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
                    for x in (np.diff(keys, prepend=np.uint64(0)), *columns))


def unpacked(data: bytes, n_columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    planes = np.frombuffer(data, np.uint8).reshape(1 + n_columns, 8, -1)
    keys, *columns = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in planes)
    return np.cumsum(keys, dtype=np.uint64), [c.view(np.int64) for c in columns]


def sent(keys: np.ndarray, columns: list[np.ndarray], bounds: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One row for each shard that gets a key; shard s begins at ``bounds[s]``."""
    cuts = np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])
    rows = [(s, packed(keys[a:b], [c[a:b] for c in columns])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    return pa.record_batch([pa.array([s for s, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()),
                            pa.array([x for _, x in rows], pa.binary())], ["shard", "kind", "sums"])


class Merged:
    """Sums of sorted arrays that come one by one.  Arrays of like size are merged, so
    little more than the sums themselves is held."""

    def __init__(self, n_columns: int):
        self.n_columns, self._held = n_columns, []

    def add(self, data: bytes) -> None:
        self._held.append(unpacked(data, self.n_columns))
        while len(self._held) > 1 and len(self._held[-2][0]) < 2 * len(self._held[-1][0]):
            self._merge()

    def _merge(self) -> None:
        (a, x), (b, y) = self._held[-2:]
        self._held[-2:] = [added(np.concatenate([a, b]), [np.concatenate(c) for c in zip(x, y)])]

    def sums(self) -> tuple[np.ndarray, list[np.ndarray]]:
        while len(self._held) > 1:
            self._merge()
        return self._held[0] if self._held else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * self.n_columns)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """Shard, kind and data of every row of a group."""
    for b in batches:
        for shard, kind, data in zip(b.column(0), b.column(1), b.column(2)):
            yield shard.as_py(), kind.as_py(), data.as_buffer()


def even_bounds(shards: int, end: float = 2.0**64) -> np.ndarray:
    return np.ceil(np.arange(shards) / shards * end).astype(np.uint64)


def counting(keys_of: Callable[[pa.Array], np.ndarray], bounds: np.ndarray):
    """Arrow task: sends how often each key of its texts occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, "text", 2 << 20):
            keys = keys_of(b.column(b.schema.get_field_index("text")))
            held.append(added(keys, [np.ones(len(keys), np.int64)]))
            size += len(held[-1][0])
            if size > _GATHER:
                yield sent(*_all_of(held), bounds)
                held, size = [], 0
        if size:
            yield sent(*_all_of(held), bounds)

    return run


def _all_of(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    return added(np.concatenate([k for k, _ in held]), [np.concatenate(c) for c in zip(*[c for _, c in held])])


# -- files ------------------------------------------------------------------------

class Store:
    """Files of arrays in a folder that all executors reach.

    A task maps a file of a mounted path as it is; of another kind of store it maps
    a temporary copy that has no name and is gone with the process.
    """

    def __init__(self, uri: str):
        self.uri = uri

    @staticmethod
    def new(spark: SparkSession, name: str) -> Store:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_dir(spark, name))
        uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        fs, base = Store(uri)._open()
        fs.create_dir(base, recursive=True)
        return Store(uri)

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        if self.uri.startswith("file:"):
            return pa.fs.LocalFileSystem(), "/" + self.uri[5:].lstrip("/")
        return pa.fs.FileSystem.from_uri(self.uri)

    def write(self, array: np.ndarray) -> str:
        """A new file; a task that runs again writes another, and its row names the one that counts."""
        fs, base = self._open()
        name = os.urandom(12).hex()
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(np.ascontiguousarray(array).tobytes())
        return name

    def map(self, name: str, dtype: type) -> np.ndarray:
        fs, base = self._open()
        if not name or not fs.get_file_info(f"{base}/{name}").size:
            return np.zeros(0, dtype)
        if isinstance(fs, pa.fs.LocalFileSystem):
            return np.memmap(f"{base}/{name}", dtype, "r")
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{base}/{name}") as source:
            shutil.copyfileobj(source, copy)
            copy.flush()
            return np.memmap(copy, dtype, "r")


def _table(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    names = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(columns[n], kinds[t]) for n, t in names], [n for n, _ in names])


FILES = "shard int, keys string, blocks string, low string, high string, size long, total long, n1 long, n2 long, n3 long, n4 long"


def keep_counts(store: Store, bounds: np.ndarray, end: float, counted: bool = True):
    """Arrow group: writes a shard's sorted keys and counts.  A count is one byte; 255
    stands for one that is listed, with its place, in the file of high counts.  Keys are
    32 bits, counted from where their block begins, unless there were too many blocks.
    Where counts are not asked for, no file of them is written, and each reads as 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Merged(1)
        for shard, _, data in parts_of(batches):
            sums.add(data)
        keys, (counts,) = sums.sums()
        counts = counts if counted else np.ones(len(counts), np.int64)
        width = (int(end) if shard + 1 == len(bounds) else int(bounds[shard + 1])) - int(bounds[shard])
        n_blocks, blocks = -(-width >> 32) + 1, ""
        size, high = len(keys), np.flatnonzero(counts > 254)
        if 4 * n_blocks < size + 4096:
            keys = keys - bounds[shard]
            blocks = store.write(np.searchsorted(keys >> np.uint64(32), np.arange(n_blocks + 1, dtype=np.uint64)))
            keys = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        seen = np.bincount(np.minimum(counts, 5), minlength=6)
        yield _table(FILES, shard=[shard], keys=[store.write(keys)], blocks=[blocks], low=[store.write(np.minimum(counts, 255).astype(np.uint8)) if counted else ""],
                     high=[store.write(np.concatenate([high, counts[high]]))], size=[size], total=[int(counts.sum())],
                     **{f"n{i}": [int(seen[i])] for i in range(1, 5)})

    return run


class Shard:
    """Sorted keys and counts of one shard, mapped from their files."""

    def __init__(self, store: Store, row, bound: np.uint64):
        self.bound, self.size = bound, row.size
        self.blocks = np.asarray(store.map(row.blocks, np.int64)) if row.blocks else None
        self.keys = np.asarray(store.map(row.keys, np.uint32 if row.blocks else np.uint64))
        self.low, self.high = np.asarray(store.map(row.low, np.uint8)), np.asarray(store.map(row.high, np.int64))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are, and whether they are there."""
        if self.blocks is None:
            place = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
            return place, self.keys[place] == keys
        offset = keys - self.bound
        block, wanted = (offset >> np.uint64(32)).astype(np.int64), (offset & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        last = self.blocks[block + 1]
        if len(keys) > _MANY * len(cuts):
            place = np.zeros(len(keys), np.int64)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # the keys asked for are sorted, so those of a block are together
                low, high = self.blocks[block[x]:block[x] + 2]
                place[x:y] = low + np.searchsorted(self.keys[low:high], wanted[x:y])
        else:  # few of each block: all keys halve their ranges together
            place, high = self.blocks[block], last.copy()
            for _ in range(int((high - place).max()).bit_length() if len(keys) else 0):
                mid = (place + high) >> 1
                less = (self.keys[np.minimum(mid, self.size - 1)] < wanted) & (place < high)
                place, high = np.where(less, mid + 1, place), np.where(less, high, mid)
        inside = place < last
        place = np.minimum(place, self.size - 1)
        return place, inside & (self.keys[place] == wanted)

    def keys_at(self, place: np.ndarray) -> np.ndarray:
        keys = self.keys[place].astype(np.uint64)
        if self.blocks is None:
            return keys
        block = (np.searchsorted(self.blocks, place, "right") - 1).astype(np.uint64)
        return (block << np.uint64(32)) + keys + self.bound

    def counts_at(self, place: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.ones(len(place), np.int64)
        counts = self.low[place].astype(np.int64)
        more = np.flatnonzero(counts == 255)
        half = len(self.high) // 2
        counts[more] = self.high[half + np.searchsorted(self.high[:half], place[more])]
        return counts


class Counts:
    """Counts of sorted keys, mapped from the files of all shards."""

    def __init__(self, files: pd.DataFrame, bounds: np.ndarray, store: Store):
        self.bounds = bounds
        rows = {r.shard: r for r in files.itertuples()}
        self.size = np.array([rows[s].size if s in rows else 0 for s in range(len(bounds))])
        self.shards = [Shard(store, rows[s], bounds[s]) if s in rows else None for s in range(len(bounds))]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and place (among the keys of all shards) of sorted keys; count 0 if a key is not there."""
        count, place = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        cuts = np.concatenate([np.searchsorted(keys, self.bounds), [len(keys)]])
        for s, base in enumerate(np.cumsum(self.size) - self.size):
            some = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1] and self.shards[s] is not None:
                at, there = self.shards[s].places(keys[some])
                place[some] = base + at
                count[cuts[s] + np.flatnonzero(there)] = self.shards[s].counts_at(at[there])
        return count, place

    def keys_at(self, place: np.ndarray) -> np.ndarray:
        """The keys of these places among the keys of all shards."""
        ends = np.cumsum(self.size)
        shard, out = np.searchsorted(ends, place, "right"), np.zeros(len(place), np.uint64)
        for s in np.unique(shard):
            some = np.flatnonzero(shard == s)
            out[some] = self.shards[s].keys_at(place[some] - (ends[s] - self.size[s]))
        return out


# -- model --------------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What a count of 0, 1, 2, 3 or more gives up.  Where a number is missing, and the
    estimate is undefined, a half of what it could give up."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[x if 0 < x < i else i / 2 for i, x in enumerate(d[1:], 1)]])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with END after each text, and for each text the tokens before it."""
    h, before = word_hashes(texts)
    return np.insert(h, before[1:], END), before + np.arange(len(before))


def preceding(number: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For every token the number of the one before it, BEGIN at the head of a text."""
    earlier = np.concatenate([[BEGIN], number[:-1]]) if len(number) else number
    earlier[before[:-1]] = BEGIN
    return earlier


SURROUNDINGS = "shard int, codes string, kinds string, n1 long, n2 long, n3 long, n4 long"


@dataclass
class KneserNey:
    """Names of the files, and the few numbers that all tasks need."""

    store: Store
    shards: int
    words: pd.DataFrame
    pairs: pd.DataFrame
    contexts: pd.DataFrame
    n_tokens: int
    n_words: int
    d_pair: np.ndarray
    d_word: np.ndarray
    n_pairs: int
    g_word: float
    order: int = 2
    triples: pd.DataFrame | None = None
    triple_contexts: pd.DataFrame | None = None
    d_triple: np.ndarray | None = None
    word_bits: int = 1
    triple_bits: int = 1
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    @staticmethod
    def fit(texts: DataFrame, text_col: str = "text", order: int = 2) -> KneserNey:
        """A model of pairs (order 2) or triples (3).  Counts all rows; a null text is an empty one.  There are four times as many
        shards as the input has partitions, so a shard holds fewer keys than a task reads.  Numbers of
        words and pairs that need more than 64 bits together raise OverflowError."""
        if order not in (2, 3):
            raise ValueError("order must be 2 or 3")
        spark, texts = texts.sparkSession, texts.select(F.col(text_col).alias("text"))
        shards = max(8, min(4096, 4 * texts.rdd.getNumPartitions()))
        store = Store.new(spark, "kneser-ney")

        def counts(keys_of: Callable[[pa.Array], np.ndarray], end: float, counted: bool = True) -> pd.DataFrame:
            bounds = even_bounds(shards, end)
            return texts.mapInArrow(counting(keys_of, bounds), SENT).groupBy("shard").applyInArrow(
                keep_counts(store, bounds, end, counted), FILES).toPandas()

        words = counts(lambda t: tokens(t)[0], 2.0**64)
        model = KneserNey(store, shards, words, words[:0], words[:0], int(words["total"].sum()), int(words["size"].sum()),
                          np.zeros(4), np.zeros(4), 0, 1.0, order)
        model.word_bits = bits_for(model.n_words + FIRST)
        model._fits(2 * model.word_bits)
        model.pairs = counts(lambda t: model.pair_keys(*model.numbered(t)[::2]), 2.0 ** (2 * model.word_bits), order == 2)
        model.n_pairs = int(model.pairs["size"].sum())
        model.d_pair = discounts(*model.pairs[["n1", "n2", "n3", "n4"]].sum().tolist())

        if order == 3:
            model.triple_bits = bits_for(model.n_pairs + 1) + model.word_bits
            model._fits(model.triple_bits)
            model.triples = counts(lambda t: model.triple_keys(*model.numbered(t)[::2])[0], 2.0**model.triple_bits)
            model.d_triple = discounts(*model.triples[["n1", "n2", "n3", "n4"]].sum().tolist())
            model.triple_contexts = model._surroundings(spark, "triples", model._split_triples, model.n_pairs + 1)
            # Of pairs, the different words before them count from here on.
            model.d_pair = discounts(*model.triple_contexts[["n1", "n2", "n3", "n4"]].sum().tolist())
        model.contexts = model._surroundings(spark, "pairs", model._split_pairs, model.n_words + FIRST)
        n = model.contexts[["n1", "n2", "n3", "n4"]].sum().astype(int).tolist()
        model.d_word = discounts(*n)
        more = model.n_words - n[0] - n[1]
        model.g_word = float(model.d_word[1:] @ [n[0], n[1], more]) / model.n_pairs if model.n_pairs else 1.0
        return model

    @staticmethod
    def _fits(bits: int) -> None:
        if bits > 64:
            raise OverflowError(f"keys of {bits} bits: too many different words for 64-bit keys")

    def _bounds(self, name: str) -> np.ndarray:
        end = {"words": 2.0**64, "pairs": 2.0 ** (2 * self.word_bits), "triples": 2.0**self.triple_bits,
               "contexts": float(self.n_words + FIRST), "triple_contexts": float(self.n_pairs + 1)}[name]
        return even_bounds(self.shards, end)

    def _split_pairs(self, keys: np.ndarray, count: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """Of some pairs of a shard: the word before, how often, the word after, and what it adds to the words before that one."""
        u, w = self.pair_parts(keys)
        if self.order == 3:
            count = self._context(np.arange(base + 1, base + 1 + len(keys), dtype=np.uint64), "triple_contexts")[2]
        return u, count, w, np.ones(len(keys), np.int64)

    def _split_triples(self, keys: np.ndarray, count: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """The same of triples, with pairs for words.  No word is before a text's first, so its pair keeps its count."""
        triple = unscramble(keys, self.triple_bits)
        context, w = triple >> np.uint64(self.word_bits), triple & np.uint64((1 << self.word_bits) - 1)
        u = np.full(len(keys), BEGIN)
        inner = np.flatnonzero(context > 0)
        u[inner] = self.pair_parts(self._counts("pairs").keys_at(context[inner].astype(np.int64) - 1))[1]
        distinct, back = np.unique(self._pair(u, w), return_inverse=True)
        after = (self._counts("pairs").find(distinct)[1] + 1).astype(np.uint64)[back]
        return context, count, after, np.where(context == 0, count, 1)

    def _surroundings(self, spark: SparkSession, name: str, split, numbers: int) -> pd.DataFrame:
        """For every number as a context: what follows it, and how many different words come before it.

        Many contexts are alike, so a shard lists the different ones, and a code for each context.
        """
        files, store, shards, ends = getattr(self, name), self.store, self.shards, even_bounds(self.shards, float(numbers))
        bounds = self._bounds(name)

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pandas().itertuples()):
                shard = Shard(store, row, bounds[row.shard])
                for k in range(0, row.size, _BLOCK):
                    place = np.arange(k, min(k + _BLOCK, row.size))
                    context, count, after, more = split(shard.keys_at(place), shard.counts_at(place), row.base + k)
                    yield sent(*added(context, [count, *[(x).astype(np.int64) for x in (count == 1, count == 2, count > 2)]]), ends)
                    yield sent(*added(after, [more]), ends, 1)

        def keep_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = None
            for shard, kind, data in parts_of(batches):
                first = int(ends[shard])
                size = (int(ends[shard + 1]) if shard + 1 < shards else numbers) - first
                columns = np.zeros((5, size), np.int64) if columns is None else columns
                number, sums = unpacked(data, 1 if kind else 4)
                at = (number - np.uint64(first)).astype(np.int64)
                for c, x in zip(columns[4:] if kind else columns, sums):
                    c[at] += x  # a part has each number once
            code = np.zeros(size, np.int64)
            for c in columns:  # one more column tells some contexts apart that were alike
                code = np.unique(code * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
            _, example = np.unique(code, return_index=True)
            table = columns[:, example].T
            seen = np.bincount(np.minimum(columns[4], 5), minlength=6)
            codes = code.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)
            yield _table(SURROUNDINGS, shard=[shard], codes=[store.write(codes)], kinds=[store.write(table)],
                         **{f"n{i}": [int(seen[i])] for i in range(1, 5)})

        if not len(files):
            return pd.DataFrame(columns=[f.split()[0] for f in SURROUNDINGS.split(", ")])
        files = files.sort_values("shard")
        columns = ["shard", "keys", "blocks", "low", "high", "size"]
        listed = spark.createDataFrame(files[columns].assign(base=files["size"].cumsum() - files["size"]),
                                       "shard int, keys string, blocks string, low string, high string, size long, base long")
        return listed.repartition(max(1, len(files))).mapInArrow(around, SENT).groupBy("shard").applyInArrow(
            keep_contexts, SURROUNDINGS).toPandas()

    def _pair(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return scramble((u << np.uint64(self.word_bits)) | w, 2 * self.word_bits)

    def pair_parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = unscramble(keys, 2 * self.word_bits)
        return pair >> np.uint64(self.word_bits), pair & np.uint64((1 << self.word_bits) - 1)

    def pair_keys(self, number: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For every token the key of the pair that ends with it."""
        return self._pair(preceding(number, before), number)

    def pair_numbers(self, number: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """The different pair keys, where each token's is among them, how often each was counted, and
        its number: 1 and its place, -1 where it was not counted."""
        distinct, back = np.unique(self.pair_keys(number, before), return_inverse=True)
        count, place = self._counts("pairs").find(distinct)
        return distinct, back, count, np.where(count > 0, place + 1, -1)

    def triple_keys(self, number: np.ndarray, before: np.ndarray, here: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every token the key of the triple that ends with it, and its context: 0 before a text,
        else the number of the pair of the words before (``here`` is that of each token's own pair)."""
        if here is None:
            _, back, _, numbers = self.pair_numbers(number, before)
            here = numbers[back]
        context = np.concatenate([[0], here[:-1]]) if len(here) else here
        context[before[:-1]] = 0
        known = np.maximum(context, 0).astype(np.uint64) << np.uint64(self.word_bits)
        return scramble(known | number, self.triple_bits), context

    def _counts(self, name: str) -> Counts:
        if name not in self._open:
            self._open[name] = Counts(getattr(self, name), self._bounds(name), self.store)
        return self._open[name]

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and count of every token, and for each text the tokens before it."""
        h, before = tokens(texts)
        distinct, back = np.unique(h, return_inverse=True)
        count, place = self._counts("words").find(distinct)
        number = np.where(count > 0, place + FIRST, int(UNKNOWN)).astype(np.uint64)
        return number[back], count[back], before

    def _context(self, number: np.ndarray, name: str = "contexts") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What follows, the weight of the shorter context, and what comes before, for sorted numbers."""
        if name not in self._open:
            d, maps = self.d_pair if name == "contexts" else self.d_triple, {}
            for r in getattr(self, name).itertuples():
                kinds = np.asarray(self.store.map(r.kinds, np.int64)).reshape(-1, 5)
                weight = np.where(kinds[:, 0] > 0, kinds[:, 1:4] @ d[1:] / np.maximum(kinds[:, 0], 1), 1.0)
                codes = self.store.map(r.codes, np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
                maps[r.shard] = np.asarray(codes), kinds[:, 0], weight, kinds[:, 4]
            self._open[name] = self._bounds(name), maps
        ends, maps = self._open[name]
        total, back, before = np.zeros(len(number), np.int64), np.ones(len(number)), np.zeros(len(number), np.int64)
        cuts = np.concatenate([np.searchsorted(number, ends), [len(number)]])
        for s in range(self.shards):
            at = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1] and s in maps:
                codes, *columns = maps[s]
                code = codes[(number[at] - ends[s]).astype(np.int64)]
                total[at], back[at], before[at] = (c[code] for c in columns)
        return total, back, before

    def token_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability, base log10 probability and count of each token, and the tokens before each text."""
        number, count, before = self.numbered(texts)
        keys, back, seen, places = self.pair_numbers(number, before)
        u, w = self.pair_parts(keys)
        known, spot = np.unique(np.concatenate([u, w]), return_inverse=True)
        total, weight, earlier = self._context(known)
        u, w = spot[:len(u)], spot[len(u):]
        if self.order == 3:
            after, longer, seen = self._of_places(places)
        low = self.g_word / (self.n_words + 1)
        if self.n_pairs:
            low = low + (earlier[w] - self.d_word[np.minimum(earlier[w], 3)]) / self.n_pairs
        p = (seen - self.d_pair[np.minimum(seen, 3)]) / np.maximum(total[u], 1) + weight[u] * low
        base = np.log10((count + 0.1) / (self.n_tokens + 0.1 * (self.n_words + 1)))
        p = p[back]
        if self.order == 3:
            keys, context = self.triple_keys(number, before, places[back])
            distinct, spot = np.unique(keys, return_inverse=True)
            seen = np.where(context >= 0, self._counts("triples").find(distinct)[0][spot], 0)
            # The context of a token is the pair that ends before it; that of a text's first is none.
            none = self._of_places(np.zeros(1, np.int64))
            total, weight = (np.concatenate([y, x[back][:-1]]) for x, y in ((after, none[0]), (longer, none[1])))
            total[before[:-1]], weight[before[:-1]] = none[0][0], none[1][0]
            p = (seen - self.d_triple[np.minimum(seen, 3)]) / np.maximum(total, 1) + weight * p
        return np.log10(p), base, count, before

    def _of_places(self, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """The surroundings of pairs as :meth:`triple_keys` numbers them; of one that was not counted 0, 1 and 0."""
        known, spot = np.unique(context, return_inverse=True)
        new = known < 0
        got = self._context(np.maximum(known, 0).astype(np.uint64), "triple_contexts")
        return tuple(np.where(new, x, y)[spot] for x, y in zip((0, 1.0, 0), got))

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, n_tokens, n_known, train_tokens, base_score, score); ``row`` is the row as it came.

        A null or empty text is its end token alone.  ``score`` is the sum of log10
        probabilities; ``perplexity`` of a text is ``10 ** (-score / n_tokens)``.
        """
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in slices(batches, "text", 2 << 20):
                p, base, count, before = model.token_scores(b.column(1))
                n = np.diff(before)
                yield pa.record_batch([
                    b.column(0), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), before[:-1])),
                    pa.array(np.full(len(n), model.n_tokens)), pa.array(np.add.reduceat(base, before[:-1])),
                    pa.array(np.add.reduceat(p, before[:-1]))],
                    ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
        return wide.mapInArrow(run, (
            f"row {wide.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double"))
