"""Toxicity by a small convolutional network over hashed word embeddings.

A word is the sum of three embeddings, of the hashes of the whole word and of its
first four and five bytes; hashes that few texts of the sample have are left out, so
a rare word cannot fall into the place of a telling one.  Filters of one, two and
three words slide over the whole text, each keeps its largest answer, and a logistic
unit weighs them.  The network is trained in numpy.  Where its output counts as toxic
is set for each language on texts it was not trained on, and outputs are rescaled so
that this point is 0.7 for every language; the language is told from the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.langid import _GAPS
from textmill.llm.sampling import joined_sample
from textmill.llm.words import hash_spans, slices, text_bytes, word_spans

THRESHOLD = 0.7
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
BUCKETS, DIM, FILTERS = 1 << 16, 12, 8


@dataclass
class Words:
    """The distinct words of some texts, and the texts as numbers of words."""

    code: np.ndarray
    before: np.ndarray
    keys: list[np.ndarray]

    @staticmethod
    def of(texts: pa.Array) -> Words:
        raw, at = text_bytes(pc.utf8_lower(texts.fill_null("")))
        start, end, before = word_spans(raw, at, _GAPS)
        h = hash_spans(raw, start, end)
        code, distinct = pd.factorize(h)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        s, e = start[first], end[first]
        return Words(code, before, [distinct, *[hash_spans(raw, s, np.minimum(e, s + p)) ^ np.uint64(p) for p in PREFIXES]])

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts with two blanks (the number after the last) behind each, and where each text begins."""
        blank, pad = len(self.keys[0]), max(WIDTHS) - 1
        return (np.insert(self.code, np.repeat(self.before[1:], pad), blank),
                self.before + pad * np.arange(len(self.before)))


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place + 1 of each key among the sorted known ones, 0 if it is not there."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


@dataclass
class ToxicityModel:
    #: Sorted known hashes of words and prefixes, and for each what it adds to every filter at every place.
    known: list[np.ndarray]
    answers: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str]
    #: For each known word (and 0: none) the log share of each language's words.
    language_logs: np.ndarray
    thresholds: np.ndarray

    @staticmethod
    def fit(sample: pd.DataFrame, weight_of_clean: float = 1.0, epochs: int = 6, batch: int = 32, rate: float = 0.01,
            min_docs: int = 4, min_each: int = 15, seed: int = 11) -> ToxicityModel | float:
        """Learns from (text, toxic, lang).  ``weight_of_clean`` is how many rows of all a
        clean row of the sample stands for, if a toxic one stands for one.  With one kind of
        label only there is nothing to learn: the share of toxic rows is the model."""
        sample = sample.sample(frac=1, random_state=seed) if len(sample) else sample
        truth = sample["toxic"].to_numpy(dtype=np.float64)
        if not len(sample) or truth.min() == truth.max():
            return float(truth.mean()) if len(sample) else 0.0
        rng = np.random.default_rng(seed)
        words = Words.of(pa.array(sample["text"].tolist(), pa.string()))
        doc = np.repeat(np.arange(len(sample)), np.diff(words.before))
        known = []
        for keys in words.keys:
            seen = pd.DataFrame({"k": keys[words.code], "d": doc}).drop_duplicates()["k"].value_counts()
            known.append(np.sort(seen.index[seen >= min_docs].to_numpy(np.uint64)))
        places = [_places(k, keys) for k, keys in zip(known, words.keys)]
        buckets = [np.where(p > 0, 1 + (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % (BUCKETS - 1), 0)
                   for p, keys in zip(places, words.keys)]
        bucket = np.stack([np.append(b, 0) for b in buckets], axis=1)  # the blank is the last word
        e = rng.normal(0, 0.1, (BUCKETS, DIM))
        e[0] = 0
        w = [rng.normal(0, 0.3, (k, DIM, FILTERS)) for k in WIDTHS]
        b = np.zeros(FILTERS * len(WIDTHS))
        v, c = rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0
        fit_rows = np.arange(len(sample)) < 0.7 * len(sample)
        train = np.flatnonzero(fit_rows)
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, *w, b, v, np.zeros(1))]
        step = 0
        code, begin = words.padded()
        for epoch in range(epochs):
            rng.shuffle(train)
            for a in range(0, len(train), batch):
                part = train[a:a + batch]
                ids = np.concatenate([code[begin[d]:begin[d + 1]] for d in part])
                size = begin[part + 1] - begin[part]
                start = np.cumsum(size) - size
                x = e[bucket[ids]].sum(axis=1)
                top, where = [], []
                for k, wk in zip(WIDTHS, w):
                    z = np.zeros((len(x), FILTERS))
                    for j in range(k):
                        z[:len(x) - j] += x[j:] @ wk[j]
                    m = np.maximum.reduceat(z, start, axis=0)
                    hit = z == np.repeat(m, size, axis=0)
                    rows, cols = np.nonzero(hit)
                    owner = np.repeat(np.arange(len(part)), size)[rows]
                    pos = np.full((len(part), FILTERS), -1)
                    pos[owner[::-1], cols[::-1]] = rows[::-1]
                    top.append(m)
                    where.append(pos)
                pooled = np.hstack(top) + b
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ v + c, -30, 30)))
                d = (p - truth[part]) / len(part)
                dv, dc = active.T @ d, np.array([d.sum()])
                dp = d[:, None] * v * (pooled > 0)
                dw, dx = [np.zeros_like(wk) for wk in w], np.zeros_like(x)
                for i, (k, wk) in enumerate(zip(WIDTHS, w)):
                    g = dp[:, i * FILTERS:(i + 1) * FILTERS]
                    for f in range(FILTERS):
                        for j in range(k):
                            at = np.minimum(where[i][:, f] + j, len(x) - 1)
                            dw[i][j, :, f] = x[at].T @ g[:, f]
                            np.add.at(dx, at, g[:, f, None] * wk[j, :, f])
                live = np.flatnonzero(np.abs(dx).sum(axis=1))
                de = np.zeros_like(e)
                for kind in range(bucket.shape[1]):
                    np.add.at(de, bucket[ids[live], kind], dx[live])
                de[0] = 0
                step += 1
                touched = np.flatnonzero(np.abs(de).sum(axis=1))
                c_ = np.array([c])
                for x_, g, (m1, m2) in zip((e, *w, b, v, c_), (de, *dw, dp.sum(axis=0), dv, dc), moments):
                    at = touched if x_ is e else slice(None)
                    m1[at] = 0.9 * m1[at] + 0.1 * g[at]
                    m2[at] = 0.99 * m2[at] + 0.01 * g[at] ** 2
                    x_[at] -= rate * (m1[at] / (1 - 0.9**step)) / (np.sqrt(m2[at] / (1 - 0.99**step)) + 1e-8)
                c = float(c_[0])
        flat = np.concatenate([wk[j] for wk in w for j in range(len(wk))], axis=1)  # (DIM, all places of all filters)
        answers = []
        for k, keys, p, bk in zip(known, words.keys, places, buckets):
            table = np.zeros((len(k) + 1, flat.shape[1]), np.float32)
            table[p[p > 0]] = e[bk[p > 0]] @ flat
            answers.append(table)
        lang = sample["lang"].fillna("").to_numpy()
        languages = sorted(set(lang[lang != ""])) or [""]
        logs = np.zeros((len(known[0]) + 1, len(languages)), np.float32)
        for i, name in enumerate(languages):
            rows = places[0][words.code[np.isin(doc, np.flatnonzero(lang == name))]] if name else places[0][words.code]
            n = np.bincount(rows, minlength=len(logs)) + 0.5
            logs[:, i] = np.log(n / n.sum())
        logs[0] = 0
        model = ToxicityModel(known, answers, b.astype(np.float32), v.astype(np.float32), c, languages, logs,
                              np.full(len(languages), 0.5))
        held = np.flatnonzero(~fit_rows)
        if len(held):
            p, spoken = model.outputs(pa.array(sample["text"].iloc[held].tolist(), pa.string()))
            weights = np.where(truth[held] > 0, 1.0, weight_of_clean)
            common = best_threshold(p, truth[held], weights)
            for i in range(len(languages)):
                own = spoken == i
                enough = min(truth[held][own].sum(), (1 - truth[held][own]).sum()) >= min_each
                model.thresholds[i] = best_threshold(p[own], truth[held][own], weights[own]) if enough else common
        return model

    def outputs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The network's output and the language of each text."""
        words = Words.of(texts)
        places = [_places(k, keys) for k, keys in zip(self.known, words.keys)]
        per_word = sum(t[p] for t, p in zip(self.answers, places))
        per_word = np.vstack([per_word, np.zeros((1, per_word.shape[1]), np.float32)])
        code, begin = words.padded()
        pooled, col = [], 0
        for k in WIDTHS:
            z = per_word[code, col:col + FILTERS]
            for j in range(1, k):
                z[:len(code) - j] += per_word[code[j:], col + j * FILTERS:col + (j + 1) * FILTERS]
            col += k * FILTERS
            pooled.append(np.maximum.reduceat(z, begin[:-1], axis=0))
        active = np.maximum(np.hstack(pooled) + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.out_bias, -30, 30)))
        logs = np.vstack([self.language_logs[places[0]], np.zeros((1, len(self.languages)), np.float32)])
        return p.astype(np.float64), np.add.reduceat(logs[code], begin[:-1], axis=0).argmax(axis=1)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score (0.7 at the language's threshold) and language of each text."""
        p, spoken = self.outputs(texts)
        t = self.thresholds[spoken]
        return np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t)), spoken


def best_threshold(p: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> float:
    """Where the weighted F1 is best, in the middle of the gap below the last row that counts as toxic."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum((truth * weights)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + (truth * weights).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    at = int(f1.argmax())
    low = p[at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[at] + low) / 2, 0.02, 0.98))


def _predict(shared):
    """Arrow task: (row, text) to the row and its score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text", 2 << 20):
            if isinstance(model, float):
                score, names = np.full(b.num_rows, model), [None] * b.num_rows
            else:
                score, spoken = model.scores(b.column(1))
                names = [model.languages[i] for i in spoken]
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                                   pa.array(names, pa.string())], ["row", "score", "predicted", "language"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 4000, max_chars: int = 30_000) -> ToxicityModel | float:
    """A model from documents (doc_id, text, lang) and labels (doc_id, toxic); a bounded
    sample of either label is read."""
    marked = labels.filter("toxic in (0, 1)").select("doc_id", "toxic")
    share = {r["toxic"]: min(1.0, per_label / r["count"]) for r in marked.groupBy("toxic").count().collect()}
    sample = joined_sample(docs.select("doc_id", "text", "lang"), marked, "toxic", per_label, max_chars, 2)
    return ToxicityModel.fit(sample, share.get(1, 1.0) / share.get(0, 1.0))


def score_toxicity(docs: DataFrame, model: ToxicityModel | float, text_col: str = "text") -> DataFrame:
    """(row, score, predicted, language); ``row`` is the row of ``docs`` as it came.

    A null text is an empty one, which has a score like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return wide.mapInArrow(_predict(shared), (
        f"row {wide.schema['row'].dataType.simpleString()}, score double, predicted int, language string"))
