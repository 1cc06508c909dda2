"""Alignment of two tokenizers over the distinct texts of a table.

Texts are shuffled whole, so each different text is tokenised and aligned once; how
many rows have it is its weight.  Both tokenizers cut the same bytes.  Where tokens of
both end, a group ends; between any two neighbouring ends, of either tokenizer, just
one token of each overlaps, which is a link.  So everything follows from marks on the
bytes, for many texts at once.

A pair of ids counts the rows that hold it linked: each text names its distinct pairs
once, weighted.  The counts are sorted arrays in files that the tasks map, so what a
task holds does not grow with the number of pairs.  Measures are joined to the rows by
a digest of the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.kneser_ney import Store
from textmill.llm.tables import stored
from textmill.llm.words import slices

#: How the byte-level tokenizer parts a text before it merges bytes (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task adds up its pairs when it holds this many.
_GATHER = 1_000_000
_NO_TOKENS = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0}


# -- tokenizers -----------------------------------------------------------------

def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand
    for themselves, the others, in order, for those from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@dataclass
class ByteLevel:
    """A byte-level BPE from its JSON file; text is encoded without special tokens, their strings are plain.

    Where ids are in the order of the merges, they rank them, and a faster encoder
    gives the same ids; both class every code point alike.  It cannot match runs of very many blanks,
    so a text with such runs goes to the slower one.
    """

    path: str
    _slow: object = field(init=False, repr=False)
    _fast: object = field(init=False, repr=False)
    vocabulary: Vocabulary = field(init=False, repr=False)

    def __post_init__(self):
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self._slow = Tokenizer.from_file(self.path)
        self._slow.encode_special_tokens = True
        of_char = byte_of_char()
        tokens = [b""] * (1 + max(model["vocab"].values()))
        for token, i in model["vocab"].items():
            tokens[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)
        self._fast = self._ranked(model, tokens)

    def _ranked(self, model: dict, tokens: list[bytes]):
        import tiktoken

        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        single = {i for i, t in enumerate(tokens) if len(t) == 1}
        ranks = {tokens[i]: i for i in single | set(merged)}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return np.asarray(self._fast.encode_ordinary(text), np.int64)
            except BaseException as e:  # the encoder's panic at very long runs is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentencepiece model, which adds a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        self.vocabulary = Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.int64) for ids in self._model.encode(texts, num_threads=1)]


@cache
def _byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


# -- alignment --------------------------------------------------------------------

def _counts_between(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks each text has; text i has the places above at[i], up to at[i + 1]."""
    return np.diff(np.cumsum(marks, dtype=np.int64)[at])


@cache
def _digits(size: int) -> np.ndarray:
    """Each number's decimal digits, filled up with 0 bytes, and a place for what follows."""
    wide = np.char.mod("%d", np.arange(size)).astype("S")
    return np.pad(wide.view(np.uint8).reshape(size, -1), ((0, 0), (0, 1)))


@dataclass
class Aligned:
    """Texts of one batch, by their place in it; texts that the tokens do not spell have none."""

    place: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    #: Text (as an index into ``place``), A id and B id of every link.
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    #: Decimal spelling of the groups of each text.
    groups: list[bytes]


def align(texts: list[str], a_ids: list[np.ndarray], b_ids: list[np.ndarray], va: Vocabulary, vb: Vocabulary) -> Aligned:
    raws = [b" " + t.encode() for t in texts]

    def spelled(i: int) -> bool:
        return all(v.length[x].sum() == len(raws[i]) and v.spelled(x).tobytes() == raws[i] for v, x in ((va, a_ids[i]), (vb, b_ids[i])))

    kept = [i for i, t in enumerate(texts) if t and spelled(i)]
    at = np.concatenate([[0], np.cumsum([len(raws[i]) for i in kept])]).astype(np.int64)
    a = np.concatenate([np.zeros(0, np.int64), *[a_ids[i] for i in kept]])
    b = np.concatenate([np.zeros(0, np.int64), *[b_ids[i] for i in kept]])
    end_a, end_b = np.cumsum(va.length[a]), np.cumsum(vb.length[b])
    in_a, in_b = np.zeros(at[-1] + 1, bool), np.zeros(at[-1] + 1, bool)
    in_a[end_a] = in_b[end_b] = True
    done_a, done_b = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32)
    both, either = in_a & in_b, in_a | in_b
    ends = np.flatnonzero(either)
    n_links = _counts_between(either, at)

    cuts = np.concatenate([[0], np.flatnonzero(both)])
    before = np.cumsum(both, dtype=np.int32)
    spot_a = np.arange(len(a)) + done_b[cuts[before[end_a - 1]]]
    spot_b = np.arange(len(b)) + done_a[cuts[before[end_b - 1] + 1]]
    ids = np.zeros(len(a) + len(b), np.int64)
    after = np.full(len(ids), ord(","), np.uint8)
    ids[spot_a], ids[spot_b] = a, b
    after[spot_a[both[end_a]]], after[spot_b[both[end_b]]] = ord("|"), ord(";")
    wide = _digits(max(va.size, vb.size))[ids]
    wide[:, -1] = after
    n_a, n_b = _counts_between(in_a, at), _counts_between(in_b, at)
    sizes = np.concatenate([[0], np.cumsum((wide != 0).sum(axis=1))])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    flat = wide.ravel()
    flat = flat[flat != 0]
    return Aligned(np.array(kept, np.int64), n_a, n_b, _counts_between(both, at), n_links,
                   np.repeat(np.arange(len(kept)), n_links), a[done_a[ends - 1]], b[done_b[ends - 1]],
                   [flat[x:y - 1].tobytes() for x, y in zip(sizes, sizes[1:])])


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, the bytes of equal weight side by side: files compress their zeros away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


ALIGNED = ("digest binary, weight long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs binary, times binary")


def _aligning(a_path: str, b_path: str):
    """Arrow task: (text, weight) to the measures of each text, its distinct pairs and how often it links them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _byte_level(a_path), _pieces(b_path)
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column(0).to_pylist()
            al = align(texts, [one.encode(" " + t) for t in texts], two.encode(texts), one.vocabulary, two.vocabulary)
            pair = (al.link_text.astype(np.uint64) << np.uint64(32)) | (al.link_a * two.vocabulary.size + al.link_b).astype(np.uint64)
            pair, times = np.unique(pair, return_counts=True)
            cut = np.searchsorted(pair >> np.uint64(32), np.arange(len(al.place) + 1, dtype=np.uint64))
            pair = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            spans = list(zip(cut, cut[1:]))
            yield pa.record_batch([
                pa.array([hashlib.sha256(texts[i].encode()).digest() for i in al.place], pa.binary()),
                batch.column(1).take(pa.array(al.place)), pa.array(al.n_a), pa.array(al.n_b), pa.array(al.n_groups), pa.array(al.n_links),
                pa.array([hashlib.sha256(g).hexdigest() for g in al.groups], pa.string()),
                pa.array([planes(np.diff(pair[x:y], prepend=np.uint32(0))) for x, y in spans], pa.binary()),
                pa.array([planes(times[x:y]) for x, y in spans], pa.binary())], [c.split()[0] for c in ALIGNED.split(", ")])

    return run


# -- counts of pairs ----------------------------------------------------------------

def _pairs_of(column: pa.Array) -> list[np.ndarray]:
    return [np.cumsum(unplanes(x.as_buffer()), dtype=np.uint32) for x in column]


def _adding(size_b: int):
    """Arrow task: (weight, pairs) to the weight of every pair that the task has seen."""
    def told(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, spot = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, spot, np.concatenate(weights))
        return distinct, sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held, floor = [], [], 0, 0
        def rows() -> pa.RecordBatch:
            a, b = np.divmod(keys[0].astype(np.int64), size_b)
            return pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(weights[0])], ["a", "b", "n"])

        for batch in batches:
            for weight, pairs in zip(batch.column(0).to_pylist(), _pairs_of(batch.column(1))):
                keys.append(pairs)
                weights.append(np.full(len(pairs), weight, np.int64))
                held += len(pairs)
                if held - floor > _GATHER:
                    keys, weights = map(lambda x: [x], told(keys, weights))
                    held = floor = len(keys[0])
                    if held > 4 * _GATHER:
                        yield rows()
                        keys, weights, held, floor = [], [], 0, 0
        if keys:
            keys, weights = map(lambda x: [x], told(keys, weights))
            yield rows()

    return run


def _filing(store: Store, size_b: int):
    """Arrow task: sorted (a, b, n, best) to files of keys and counts; a count's sign says whether it is its A id's highest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * size_b + b.column(1).to_numpy()
            n = b.column(2).to_numpy()
            keys.append(key.astype(np.uint32))
            counts.append(np.where(n == b.column(3).to_numpy(), -n, n))
        key, count = np.concatenate(keys), np.concatenate(counts)
        if len(key):
            yield pa.record_batch([pa.array([int(key[0])]), pa.array([store.write(key)]), pa.array([store.write(count)])],
                                  ["first", "keys", "counts"])

    return run


class PairCounts:
    """Counts of sorted pairs, mapped from files; file k begins at ``first[k]``."""

    def __init__(self, store: Store, files: list[tuple[int, str, str]]):
        files = sorted(files)
        self.first = np.array([f for f, *_ in files], np.uint32)
        self.maps = [(store.map(k, np.uint32), store.map(c, np.int64)) for _, k, c in files]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of sorted pairs that were all counted, and whether it is the highest of the A id."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.concatenate([np.searchsorted(keys, self.first), [len(keys)]])
        for k, (stored_keys, counts) in enumerate(self.maps):
            some = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                out[some] = counts[np.searchsorted(stored_keys, keys[some])]
        return np.abs(out), out < 0


MEASURES = ("digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _measuring(store: Store, files: list[tuple[int, str, str]]):
    """Arrow task: the aligned texts to their measures, with the counts of their links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts(store, files)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                pairs, times = _pairs_of(b.column(6)), [unplanes(x.as_buffer()) for x in b.column(7)]
                known, spot = np.unique(np.concatenate(pairs), return_inverse=True)
                n, best = counts.find(known)
                n, best, many = n[spot], best[spot], np.concatenate(times).astype(np.int64)
                at = np.concatenate([[0], np.cumsum([len(p) for p in pairs])])[:-1]
                yield pa.record_batch([*b.columns[:5], pa.array(np.add.reduceat(many * best, at)),
                                       pa.array(np.add.reduceat(many * n, at)), b.column(5)], [c.split()[0] for c in MEASURES.split(", ")])

    return run


@dataclass(frozen=True)
class Alignment:
    """``texts``: the distinct texts that both tokenizers spell, by digest, with their pairs;
    ``pairs`` (a, b, n, best): the rows that link each pair, and the highest n of its A id."""

    texts: DataFrame
    pairs: DataFrame
    size_b: int

    @staticmethod
    def build(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> Alignment:
        """Aligns the distinct texts; each row is a document, repeated rows too.  A null or
        empty text, and one that the tokens of either side do not spell, has no tokens."""
        distinct = docs.select(F.col(text_col).alias("text")).filter("text is not null and text <> ''").groupBy("text").agg(
            F.count("*").alias("weight"))
        texts = stored(distinct.mapInArrow(_aligning(a_path, b_path), ALIGNED), "aligned")
        size_b = _pieces(b_path).vocabulary.size
        # A window holds the pairs of one A id: as many as B has ids, at most.
        pairs = texts.select("weight", "pairs").mapInArrow(_adding(size_b), "a int, b int, n long").groupBy("a", "b").agg(
            F.sum("n").alias("n")).withColumn("best", F.max("n").over(Window.partitionBy("a")))
        return Alignment(texts, stored(pairs, "pairs"), size_b)

    def measures(self) -> DataFrame:
        """(digest, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of the distinct texts."""
        store = Store.new(self.pairs.sparkSession, "pair-counts")
        files = self.pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", "n", "best").mapInArrow(
            _filing(store, self.size_b), "first long, keys string, counts string").collect()
        return self.texts.select(
            "digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(
            _measuring(store, [tuple(f) for f in files]), MEASURES)

    def of_rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The measures of every row by its id, which may be null or repeated; zeros and '' without tokens."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("digest"))
        return rows.join(self.measures(), "digest", "left").drop("digest").fillna(_NO_TOKENS | {"groups_sha256": ""})
