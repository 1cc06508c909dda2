"""N-grams of Arrow batches, counted as numbers.

Words or characters of a batch become small codes, and an n-gram the number that its codes
spell.  Occurrences are counted by sorting these numbers; only the different n-grams of a
slice of rows, or those of a vocabulary, ever exist as strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = 1 << 21  # of the texts that are counted at a time, if it is more than one
_WEIGHED = 1 << 19  # of the texts that are weighed at a time
_ROWS = 1 << 16
_SPAN = 1 << 62  # of keys with their rows

COUNTS = "term string, df long, tf long"


def _slices(*columns: pa.Array, limit: int = _BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of bounded size."""
    total = np.concatenate([[0], np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False) for c in columns), dtype=np.int64)])
    a, n = 0, len(columns[0])
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        b = min(b, a + _ROWS, n)
        yield a, b
        a = b


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of an ordered array, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


class Codes:
    """Rows of codes below ``base``, one after another, and the keys of their n-grams, n from 1 upwards.

    A key is the number in base ``base`` that the codes spell.  Where such numbers (with the
    row before them) would pass 62 bits, the keys of n - 1 are first replaced by their ranks.
    """

    def __init__(self, row: np.ndarray, code: np.ndarray, base: int, rows: int):
        self.row, self.code, self.base, self.rows = row, code, max(base, 1), max(rows, 1)
        self.n, self.keys, self.span = 1, code, self.base
        self.ranked: dict[int, np.ndarray] = {}

    def grow(self) -> None:
        """From n to n + 1."""
        keys = self.keys[:-1]
        if self.span * self.base * self.rows >= _SPAN:
            self.ranked[self.n + 1], keys = np.unique(keys, return_inverse=True)
            self.span = max(1, len(self.ranked[self.n + 1]))
        self.keys = keys * self.base + self.code[self.n:]
        self.span *= self.base
        self.n += 1

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the n-grams that lie in one row."""
        first = self.row[:len(self.keys)]
        within = first == self.row[self.n - 1:]
        return first[within], self.keys[within]

    def spelled(self, keys: np.ndarray) -> list[np.ndarray]:
        """The codes of keys: n arrays."""
        out = []
        for n in range(self.n, 1, -1):
            out.append(keys % self.base)
            keys = keys // self.base
            if n in self.ranked:
                keys = self.ranked[n][keys]
        return [keys, *out[::-1]]

    def key_of(self, codes: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of an n-column matrix of codes, -1 where there can be none."""
        keys, known = codes[:, 0].copy(), (codes >= 0).all(axis=1)
        for n in range(2, self.n + 1):
            if n in self.ranked:
                table = self.ranked[n]
                at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
                known &= (table[at] == keys) if len(table) else False
                keys = at
            keys = keys * self.base + codes[:, n - 1]
        return np.where(known, keys, -1)


class Words:
    """Words between single blanks."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy()
        flat = lists.values.slice(at[0], at[-1] - at[0])
        row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
        coded = flat.dictionary_encode()
        self.words = coded.dictionary
        code, some = coded.indices.to_numpy().astype(np.int64), pc.binary_length(flat).to_numpy() > 0
        self.codes = Codes(row[some], code[some], len(self.words), len(texts))

    def terms(self, keys: np.ndarray) -> pa.Array:
        words = [self.words.take(pa.array(c)) for c in self.codes.spelled(keys)]
        return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")

    @staticmethod
    def parts(term: str) -> list[str]:
        return term.split(" ")

    def code_of(self, parts: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(parts, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Characters:
    """Code points."""

    def __init__(self, texts: pa.Array):
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        points = np.frombuffer(bytes(data[int(at[0]):int(at[-1])]).decode().encode("utf-32-le"), np.uint32) if data else np.zeros(0, np.uint32)
        there = np.zeros(0x110000, bool)
        there[points] = True
        self.alphabet = np.flatnonzero(there)
        self.rank = np.cumsum(there) - 1
        self.rank[~there] = -1
        row = np.repeat(np.arange(len(texts), dtype=np.int64), size)
        self.codes = Codes(row, self.rank[points], len(self.alphabet), len(texts))

    def terms(self, keys: np.ndarray) -> pa.Array:
        points = np.stack([self.alphabet[c] for c in self.codes.spelled(keys)], axis=1)
        size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        data = points.astype(np.uint32).tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(keys), pa.py_buffer(at), pa.py_buffer(data))

    @staticmethod
    def parts(term: str) -> list[str]:
        return list(term)

    def code_of(self, parts: pa.Array) -> np.ndarray:
        return np.array([self.rank[ord(p)] for p in parts.to_pylist()], np.int64)


def counting(kind: type, ngram_range: tuple[int, int]):
    """Arrow task: texts to (term, df, tf) of their slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in _slices(texts):
                cut = kind(texts.slice(a, b - a))
                codes = cut.codes
                for n in range(1, ngram_range[1] + 1):
                    if n > 1:
                        codes.grow()
                    if n < ngram_range[0]:
                        continue
                    row, key = codes.inside()
                    keys, tf = _runs(np.sort(key))
                    # A row's equal n-grams count once; then as above, so in the order of the same keys.
                    once = _runs(np.sort(row * codes.span + key))[0]
                    df = _runs(np.sort(once % codes.span))[1]
                    if len(keys):
                        yield pa.record_batch([cut.terms(keys), pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["term", "df", "tf"])

    return run


def pieces(*columns: pa.Array, others: Sequence[pa.Array] = ()) -> Iterator[list[pa.Array]]:
    """The columns, and ``others`` with them, cut into slices that are weighed one by one."""
    for a, b in _slices(*columns, limit=_WEIGHED):
        yield [c.slice(a, b - a) for c in (*columns, *others)]


class Vocabulary:
    """Terms of a block by their n, as parts, with the index of each."""

    def __init__(self, kind: type, terms: Sequence[str], ngram_range: tuple[int, int]):
        self.kind, self.most = kind, ngram_range[1]
        split = [kind.parts(t) for t in terms]
        names = {p: i for i, p in enumerate(dict.fromkeys(p for parts in split for p in parts))}
        self.parts = list(names)
        self.by_n = {}
        for n in range(ngram_range[0], ngram_range[1] + 1):
            own = [i for i, parts in enumerate(split) if len(parts) == n]
            if own:
                self.by_n[n] = np.array(own), np.array([[names[p] for p in split[i]] for i in own])

    def found(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, index of the term) of every occurrence."""
        cut = self.kind(texts)
        code, codes = cut.code_of(pa.array(self.parts, pa.string())), cut.codes
        for n in range(1, self.most + 1):
            if n > 1:
                codes.grow()
            if n not in self.by_n:
                continue
            index, parts = self.by_n[n]
            own = codes.key_of(code[parts])
            order = np.argsort(own)
            order = order[np.searchsorted(own[order], 0):]
            if not len(order):
                continue
            row, key = codes.inside()
            sought = own[order]
            at = np.minimum(np.searchsorted(sought, key), len(sought) - 1)
            hit = sought[at] == key
            yield row[hit], index[order[at[hit]]]


def parts_of(vocabularies: Sequence[Vocabulary], idfs: Sequence[np.ndarray]) -> np.ndarray:
    """The vocabulary of every index."""
    return np.repeat(np.arange(len(vocabularies)), [len(i) for i in idfs])


def counted(vocabularies: Sequence[Vocabulary], idfs: Sequence[np.ndarray], columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of each row, index and tf of the cells in order)."""
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in idfs])]).astype(np.int64)
    width, rows = int(offsets[-1]), len(columns[0])
    cells = [row * width + offsets[k] + index for k, v in enumerate(vocabularies) for row, index in v.found(columns[k])]
    cell, tf = _runs(np.sort(np.concatenate([np.zeros(0, np.int64), *cells])))
    return np.bincount(cell // width, minlength=rows), cell % width, tf


def weights(row: np.ndarray, rows: int, tf: np.ndarray, idf: np.ndarray, part: np.ndarray, parts: int, sublinear: bool) -> np.ndarray:
    """Weights of cells: tf, idf and unit length of a row within each part."""
    weight = (1.0 + np.log(tf) if sublinear else tf.astype(float)) * idf
    part = row * parts + part
    return weight / np.sqrt(np.bincount(part, weight * weight, rows * parts))[part]


def weighing(vocabularies: Sequence[Vocabulary], idfs: Sequence[np.ndarray], sublinear: bool):
    """Arrow function: one column of texts for each vocabulary to rows (indices, values) with
    tf, idf and unit length within each vocabulary."""
    idf, part_of = np.concatenate(idfs), parts_of(vocabularies, idfs)

    def slice_rows(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, index, tf = counted(vocabularies, idfs, columns)
        row = np.repeat(np.arange(len(sizes)), sizes)
        return sizes, index.astype(np.int32), weights(row, len(sizes), tf, idf[index], part_of[index], len(vocabularies), sublinear)

    def run(*columns: pa.Array) -> pa.Array:
        texts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        done = [slice_rows(part) for part in pieces(*texts)]
        sizes, index, value = (np.concatenate([np.zeros(0, kind), *[d[k] for d in done]]) for k, kind in enumerate((np.int64, np.int32, np.float64)))
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(index, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float64()))]
        return pa.StructArray.from_arrays(lists, ["indices", "values"])

    return run
