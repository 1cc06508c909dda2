"""Language of every word by a linear-chain conditional random field.

A word's features are its byte n-grams with its ends marked (so those at the ends
are affixes), longer affixes, and the word itself if it is in the lexicon.  The
weights of the features and of the transitions between neighbouring words are
learned together, on runs that switch between languages, and forward-backward gives
each word's probabilities.  The language of a text is the one with the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.sampling import labelled_sample
from textmill.llm.words import _LOWER, _MASK, hash_spans, mix, slices, text_bytes, word_spans

#: Words are runs of letters; every byte beyond ASCII counts as one.
_GAPS = np.ones(256, bool)
_GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False
_BUCKETS = 1 << 18
_RUN = 64


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(_BUCKETS - 1)).astype(np.int64)


def word_features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words, one word's after another, and where each word's begin.

    ``known`` is the sorted lexicon, ``h`` the hashes of the words.
    """
    n = end - start + 2  # with a mark at each end
    at = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(at[-1]) - at[word]
    marked = np.full(at[-1] + 8, ord("^"), np.uint8)
    inner = (place > 0) & (place < n[word] - 1)
    marked[:-8][inner] = raw[(start[word] + place - 1)[inner]]
    marked[at[1:] - 1] = ord("$")
    marked[-8:] = 0
    eight = np.ndarray((at[-1] + 1,), "<u8", marked, strides=(1,))
    parts, owners = [], []
    for size in (2, 3, 4):
        ok = np.flatnonzero(place + size <= n[word])
        parts.append(_bucket(eight[ok] & _MASK[size], size))
        owners.append(word[ok])
    for kind, where in ((5, at[:-1]), (6, np.maximum(at[1:] - 6, at[:-1]))):
        parts.append(_bucket(eight[where] & _MASK[np.minimum(n, 6)], kind))
        owners.append(np.arange(len(n)))
    spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    listed = known[spot] == h if len(known) else np.zeros(len(h), bool)
    parts.append(np.where(listed, _bucket(h, 7), 0))
    owners.append(np.arange(len(n)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (time, run, label) of the scores, and the sum of the expected transitions."""
    steps, runs, labels = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[t - 1] @ move) * e[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * beta[t + 1]
        more = (t + 1 < lengths)[:, None]
        both = alpha[t][:, :, None] * move * ahead[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += (both * more[:, :, None]).sum(axis=0)
        b = ahead @ move.T
        beta[t] = np.where(more, b / b.sum(axis=1, keepdims=True), 1.0)
    p = alpha * beta
    return p / p.sum(axis=2, keepdims=True), pairs


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The marginals alone, with less work."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(e.dtype)
    alpha = np.empty_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, len(e)):
        a = (alpha[t - 1] @ move) * e[t]
        alpha[t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(e[0])
    for t in range(len(e) - 2, -1, -1):
        b = (e[t + 1] * beta) @ move.T
        beta = np.where((t + 1 < lengths)[:, None], b / b.sum(axis=1, keepdims=True), 1.0)
        alpha[t] *= beta
        alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
    return alpha


@dataclass
class LanguageTagger:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray

    @staticmethod
    def fit(sample: pd.DataFrame, label: str = "lang", batches: int = 240, runs: int = 96, rate: float = 0.25,
            min_docs: int = 3, seed: int = 7) -> LanguageTagger | None:
        """Learns from (text, label) rows.  Half of the runs stay in one text, half
        switch among texts of any label after 4 to 24 words."""
        sample = sample[sample["text"].str.contains(r"[^\W\d_]", regex=True, na=False)] if len(sample) else sample
        labels = sorted(sample[label].unique()) if len(sample) else []
        if not labels:
            return None
        raw, at = text_bytes(pa.array(sample["text"].tolist(), pa.string()))
        raw = _LOWER[raw]
        start, end, before = word_spans(raw, at, _GAPS)
        h = hash_spans(raw, start, end)
        code, words = pd.factorize(h)
        first = np.zeros(len(words), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        doc = np.repeat(np.arange(len(sample)), np.diff(before))
        held = pd.DataFrame({"w": code, "d": doc}).drop_duplicates()["w"].value_counts()
        lexicon = np.sort(words[held.index[held >= min_docs]])
        feats, begin = word_features(raw, start[first], end[first], lexicon, words)
        gold = np.searchsorted(labels, sample[label].to_numpy())
        n_labels = len(labels)
        weights, sums = np.zeros((_BUCKETS, n_labels)), np.full((_BUCKETS, n_labels), 1e-3)
        transitions, t_sums = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-3)
        rng = np.random.default_rng(seed)
        usable = [np.flatnonzero((gold == k) & (np.diff(before) > 0)) for k in range(n_labels)]
        for _ in range(batches):
            tokens, truth = np.zeros((_RUN, runs), np.int64), np.zeros((_RUN, runs), np.int64)
            lengths = np.zeros(runs, np.int64)
            for r in range(runs):
                filled, one = 0, rng.random() < 0.5
                while filled < _RUN:
                    some = usable[rng.integers(n_labels)]
                    if len(some):
                        d = rng.choice(some)
                        span = min(before[d + 1] - before[d], _RUN - filled, _RUN if one else rng.integers(4, 25))
                        a = before[d] + rng.integers(before[d + 1] - before[d] - span + 1)
                        tokens[filled:filled + span, r] = code[a:a + span]
                        truth[filled:filled + span, r] = gold[d]
                        filled += span
                    if one and filled:
                        break
                lengths[r] = filled
            used, local = np.unique(tokens, return_inverse=True)
            local = local.reshape(tokens.shape)
            size = begin[used + 1] - begin[used]
            index = np.repeat(begin[used] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            f, owner = feats[index], np.repeat(np.arange(len(used)), size)
            scores = np.stack([np.bincount(owner, weights[f, k], len(used)) for k in range(n_labels)], axis=1)
            p, pairs = forward_backward(scores[local], lengths, transitions)
            live = np.arange(_RUN)[:, None] < lengths
            slope = (p - np.eye(n_labels)[truth]) * live[:, :, None] / runs
            by_word = np.stack([np.bincount(local.ravel(), slope[:, :, k].ravel(), len(used)) for k in range(n_labels)], axis=1)
            touched, back = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(back, by_word[owner, k], len(touched)) for k in range(n_labels)], axis=1)
            g += 1e-5 * weights[touched]
            sums[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(sums[touched])
            seen = np.zeros_like(transitions)
            np.add.at(seen, (truth[:-1][live[1:]], truth[1:][live[1:]]), 1.0)
            g = (pairs - seen) / runs
            t_sums += g * g
            transitions -= rate * g / np.sqrt(t_sums)
        return LanguageTagger(labels, weights.astype(np.float32), transitions, lexicon)

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (word, label) of all words, and for each text the words before it."""
        raw, at = text_bytes(texts)
        raw = _LOWER[raw]
        start, end, before = word_spans(raw, at, _GAPS)
        if not len(start):
            return np.zeros((0, len(self.labels)), np.float32), before
        h = hash_spans(raw, start, end)
        code, words = pd.factorize(h)
        first = np.zeros(len(words), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        scores = np.empty((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 20_000):
            part = first[a:a + 20_000]
            f, begin = word_features(raw, start[part], end[part], self.lexicon, words[a:a + 20_000])
            scores[a:a + 20_000] = np.add.reduceat(self.weights[f], begin[:-1], axis=0)
        # Texts are cut into runs of a fixed number of words, all of one step at once.
        n = np.diff(before)
        pieces = -(-n // _RUN)
        text = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = before[text] + nth * _RUN
        lengths = np.minimum(before[text + 1] - begin, _RUN)
        out = np.empty((len(start), len(self.labels)), np.float32)
        for a in range(0, len(begin), 4096):
            b, m = begin[a:a + 4096], lengths[a:a + 4096]
            place = b + np.arange(m.max())[:, None]
            live = np.arange(m.max())[:, None] < m
            p = marginals(scores[code[np.minimum(place, len(code) - 1)]], m, self.transitions)
            out[place[live]] = p[live]
        return out, before

    def languages(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text: language, score, number of words, number of switches."""
        p, before = self.tag(texts)
        n = np.diff(before)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)])
        total = total[before[1:]] - total[before[:-1]]
        best = total.argmax(axis=1)
        score = np.where(n > 0, total.max(axis=1) / np.maximum(n, 1), 0.0)
        label = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        change = np.concatenate([[0], np.cumsum(np.diff(label) != 0), [0]]) if len(p) else np.zeros(1, np.int64)
        last, begin = np.maximum(before[1:] - 1, 0), np.minimum(before[:-1], max(len(p) - 1, 0))
        switches = np.where(n > 0, change[last] - change[begin], 0)
        letters = [k > 0 and _has_letter(t) for k, t in zip(n, texts)]
        return ([self.labels[b] if ok else "und" for b, ok in zip(best, letters)],
                np.clip(np.where(letters, score, 0.0), 0.0, 1.0), n, switches)


def _has_letter(text: pa.Scalar) -> bool:
    value = text.as_py()
    return any(c.isalpha() for c in value)


def _predict(tagger):
    """Arrow task: (row, text) to the row and its language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tagger.value
        for b in slices(batches, "text"):
            if model is None:
                langs, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                n = switches = np.zeros(b.num_rows, np.int64)
            else:
                langs, score, n, switches = model.languages(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(n), pa.array(switches)],
                                  ["row", "lang_pred", "score", "n_words", "n_switches"])

    return run


def fit_languages(rows: DataFrame, label: str = "lang", per_label: int = 300, max_chars: int = 100_000,
                  max_labels: int | None = None) -> LanguageTagger | None:
    """A tagger from rows of (doc_id, text, label), on a bounded sample of every label; None if there is no label to learn."""
    return LanguageTagger.fit(labelled_sample(rows, label, per_label, max_chars, max_labels), label)


def identify(docs: DataFrame, tagger: LanguageTagger | None, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, n_words, n_switches); ``row`` is the row of ``docs`` as it came.

    The score is the mean probability of the language over the words.  A text that
    is null or has no letter is ``und`` with score 0.  A tie goes to the label that
    sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return wide.mapInArrow(_predict(shared), (
        f"row {wide.schema['row'].dataType.simpleString()}, lang_pred string, score double, n_words long, n_switches long"))
