"""A convolutional text classifier for toxicity, in numpy (after Kim, "Convolutional Neural
Networks for Sentence Classification", 2014).

A word is embedded by two hashes of it, half the vector each, so that a word takes
another's place only if both collide. Filters over one, two and three words run over the
whole text, and the largest response of each feeds a logistic output. The score is shifted
so that the cut that suits all languages best is ``CUT``; per language a threshold of its
own is calibrated besides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, raw_column, slices, tokens
from .training import Sample, best_cut, labelled_sample, sigmoid

#: Labelled rows that are learned from at most; texts are taken whole.
SAMPLE_ROWS = 8_000
MODULUS, HELD_OUT = 4, 2
CUT = 0.3
HALF = 8
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 4
BATCH = 64
RATE = 0.05
#: Words that are scored together; a word takes 350 bytes meanwhile.
SCORED_TOGETHER = 20_000
_PAD = max(WIDTHS) - 1


def hashed(raw: bytes) -> np.ndarray:
    """A 32-bit hash of each word; its halves name the two rows of the embedding."""
    found = tokens(raw)
    return np.fromiter(map(zlib.crc32, found), np.uint32, len(found))


class ToxicNet:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.low = draw.normal(0, 0.05, (BUCKETS, HALF)).astype(np.float32)
        self.high = draw.normal(0, 0.05, (BUCKETS, HALF)).astype(np.float32)
        self.filters = [draw.normal(0, 0.2, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0.2, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = 0.0
        self.shift = 0.0
        self.constant: float | None = None

    def start_from_counts(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """The first coordinate of each half starts as the smoothed log-odds of its bucket."""
        for table, half in ((self.low, lambda h: h & 0xFFFF), (self.high, lambda h: h >> 16)):
            seen = np.zeros((2, BUCKETS))
            for words, label in zip(texts, labels):
                seen[label, np.unique(half(words))] += 1
            size = np.bincount(labels, minlength=2)
            odds = np.log((seen[1] + 0.5) / (size[1] + 1)) - np.log((seen[0] + 0.5) / (size[0] + 1))
            table[:, 0] = np.where(seen.sum(0) > 0, odds / 4, 0.0)
        for filters in self.filters:
            filters[:, 0] += 0.5 / len(filters)
            filters[:, HALF] += 0.5 / len(filters)

    def _embed(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of the texts one after the other, zeros between; each text's start."""
        size = np.array([max(1, len(t)) + _PAD for t in texts])
        starts = np.cumsum(size) - size
        words = np.zeros(size.sum() + _PAD, np.uint32)
        real = np.zeros(len(words), bool)
        for start, text in zip(starts, texts):
            words[start : start + len(text)] = text
            real[start : start + len(text)] = True
        vectors = np.concatenate([self.low[words & 0xFFFF], self.high[words >> 16]], axis=1)
        vectors[~real] = 0
        return vectors, starts, words

    def _respond(self, vectors: np.ndarray) -> np.ndarray:
        """All filters at all places."""
        n = len(vectors) - _PAD
        return np.concatenate([sum(vectors[i : i + n] @ f[i] for i in range(len(f))) for f in self.filters], axis=1)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts of any length: a long one is cut into overlapping pieces, their largest
        responses taken together, which changes nothing."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        pieces, owner = [], []
        for number, text in enumerate(texts):
            for start in range(0, max(1, len(text)), SCORED_TOGETHER):
                pieces.append(text[start : start + SCORED_TOGETHER + _PAD])
                owner.append(number)
        pooled = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        held: list[int] = []
        total = 0
        for number, piece in enumerate(pieces):
            held.append(number)
            total += len(piece)
            if total >= SCORED_TOGETHER or number == len(pieces) - 1:
                vectors, starts, _ = self._embed([pieces[i] for i in held])
                most = np.maximum.reduceat(self._respond(vectors), starts, axis=0)
                np.maximum.at(pooled, [owner[i] for i in held], most)
                held, total = [], 0
        return (np.maximum(pooled + self.bias, 0) @ self.out + self.base).astype(np.float64) + self.shift

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad on the logistic loss. Only the place of the largest response of each filter
        has a gradient, so a step touches few rows of the embedding."""
        draw = np.random.default_rng(seed)
        memory = {id(p): np.full(p.shape, 1e-3, np.float32) for p in (self.low, self.high, *self.filters, self.bias, self.out)}
        base_memory = 1e-3

        def update(parameter: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
            past = memory[id(parameter)]
            past[rows] += gradient**2
            parameter[rows] -= RATE * gradient / np.sqrt(past[rows])

        for _ in range(EPOCHS):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                vectors, starts, words = self._embed([texts[i] for i in chosen])
                respond = self._respond(vectors)
                ends = np.r_[starts[1:], len(respond)]
                place = np.stack([a + respond[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
                most = np.take_along_axis(respond, place, axis=0) + self.bias
                active = np.maximum(most, 0)
                error = (sigmoid(active @ self.out + self.base) - labels[chosen]).astype(np.float32) / len(chosen)
                back = error[:, None] * self.out * (most > 0)
                gradient_out = error @ active
                table_gradient: list[tuple[np.ndarray, np.ndarray]] = []
                for number, filters in enumerate(self.filters):
                    part = slice(number * FILTERS, (number + 1) * FILTERS)
                    gradient = np.zeros_like(filters)
                    for i in range(len(filters)):
                        at_word = place[:, part] + i
                        gradient[i] = np.einsum("bfd,bf->df", vectors[at_word], back[:, part])
                        table_gradient.append((at_word.ravel(), (back[:, part, None] * filters[i].T[None]).reshape(-1, 2 * HALF)))
                    update(filters, gradient)
                where = np.concatenate([w for w, _ in table_gradient])
                push = np.concatenate([g for _, g in table_gradient])
                used = vectors[where].any(axis=1) & push.any(axis=1)
                for table, half, rows in ((self.low, slice(0, HALF), words[where[used]] & 0xFFFF), (self.high, slice(HALF, None), words[where[used]] >> 16)):
                    unique, inverse = np.unique(rows, return_inverse=True)
                    summed = np.zeros((len(unique), HALF), np.float32)
                    np.add.at(summed, inverse, push[used][:, half])
                    update(table, summed, unique)
                update(self.bias, back.sum(axis=0))
                update(self.out, gradient_out)
                base_memory += float(error.sum()) ** 2
                self.base -= RATE * float(error.sum()) / base_memory**0.5


@dataclass
class ToxicModel:
    net: ToxicNet
    #: Score from which a text of the language counts as toxic; ``CUT`` for all others.
    thresholds: dict[str, float]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.net.logits([hashed(t) for t in texts]))


def fit(sample: Sample) -> ToxicModel:
    """Learns from four fifths of the sample and calibrates on the rest. A sample without
    both classes gives a constant score: their share, near 0 or 1."""
    net = ToxicNet()
    if len(sample.labels) == 0 or sample.labels.min() == sample.labels.max():
        net.constant = 4.0 if len(sample.labels) and sample.labels[0] else -4.0
        return ToxicModel(net, {})
    texts = [hashed(t) for t in sample.texts]
    fits = ~sample.calibrates
    if len(np.unique(sample.labels[fits])) < 2 or len(np.unique(sample.labels[~fits])) < 2:
        fits = np.ones(len(texts), bool)
    judged = ~fits if not fits.all() else fits
    learned = [t for t, use in zip(texts, fits) if use]
    net.start_from_counts(learned, sample.labels[fits])
    net.learn(learned, sample.labels[fits])
    logits = net.logits([t for t, use in zip(texts, judged) if use])
    y, w = sample.labels[judged], sample.weights[judged]
    net.shift = float(np.log(CUT / (1 - CUT))) - best_cut(logits, y, w)
    logits = logits + net.shift
    languages = np.array([x for x, use in zip(sample.languages, judged) if use])
    thresholds = {}
    for language in sorted(set(languages) - {""}):
        own = languages == language
        if min(np.bincount(y[own], minlength=2)) >= 20:
            thresholds[str(language)] = float(sigmoid(np.array(best_cut(logits[own], y[own], w[own]))))
    return ToxicModel(net, thresholds)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    return fit(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows))


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row; null texts count as empty."""

    def run(texts: list[bytes]) -> dict:
        return {"score": (pa.float64(), model.scores(texts))}

    made = map_texts(docs, run, "score double")
    return made.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold of their
    language; an unknown or null language has ``CUT``."""
    languages = "lang" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = raw_column(batch, "text")
            lang = batch.column("lang").to_pylist() if languages else [None] * len(texts)
            limit = np.array([model.thresholds.get(str(x), CUT) for x in lang])
            yield batch.filter(pa.array(model.scores(texts) < limit))

    return docs.mapInArrow(run, docs.schema)
