"""A byte-level convolutional network for text quality, in numpy.

The whole text is cut into overlapping chunks of bytes. Learned filters of eight bytes move
over each chunk in steps of four, the largest response of each filter describes the chunk,
and mean and maximum over all chunks are combined into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts
from .training import Sample, best_cut, labelled_sample, sigmoid

#: Labelled rows that are learned from at most; texts are taken whole.
SAMPLE_ROWS = 5_000
MODULUS, HELD_OUT = 3, 1
CUT = 0.5
STEP = 4
DIMENSIONS = 6
FILTERS = 24
#: Steps in a chunk, and steps that neighbouring chunks share.
CHUNK_STEPS = 96
OVERLAP_STEPS = 16
EPOCHS = 5
BATCH = 32
RATE = 0.02
SCORED_TOGETHER = 1 << 20


def chunk_starts(steps: int) -> list[int]:
    """Starts of the chunks of a text of so many steps; the last one ends with the text."""
    last = max(0, steps - CHUNK_STEPS)
    return [*range(0, last, CHUNK_STEPS - OVERLAP_STEPS), last]


class ByteNet:
    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.5, (257, DIMENSIONS)).astype(np.float32)  # 256: beyond the end
        self.first = draw.normal(0, 0.25, (STEP * DIMENSIONS, FILTERS)).astype(np.float32)
        self.second = draw.normal(0, 0.25, (STEP * DIMENSIONS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.shift = 0.0
        self.constant: float | None = None

    def _respond(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Responses at all steps, the groups of bytes, chunk starts, and chunks per text."""
        codes, starts, counts, at = [], [], [], 0
        for text in texts:
            steps = max(CHUNK_STEPS, -(-len(text) // STEP))
            padded = np.full((steps + 1) * STEP, 256, np.int64)  # one step more for the filters' second half
            padded[: len(text)] = np.frombuffer(text, np.uint8)
            codes.append(padded)
            own = chunk_starts(steps)
            starts += [at + s for s in own]
            counts.append(len(own))
            at += steps + 1
        groups = np.concatenate(codes)
        vectors = self.table[groups].reshape(-1, STEP * DIMENSIONS)
        respond = vectors @ self.first
        respond[:-1] += (vectors @ self.second)[1:]
        return respond, groups.reshape(-1, STEP), np.array(starts), counts

    def _pool(self, respond: np.ndarray, starts: np.ndarray, counts: list[int]) -> np.ndarray:
        borders = np.stack([starts, starts + CHUNK_STEPS], axis=1).ravel()
        chunks = np.maximum(np.maximum.reduceat(respond, borders, axis=0)[::2] + self.bias, 0)
        begin = np.cumsum(counts) - counts
        return np.concatenate([np.add.reduceat(chunks, begin, axis=0) / np.array(counts)[:, None], np.maximum.reduceat(chunks, begin, axis=0)], axis=1)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """A long text is scored piece by piece: pieces are whole runs of its chunks, sums and
        maxima over them are put together."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        hop = (CHUNK_STEPS - OVERLAP_STEPS) * STEP
        piece = SCORED_TOGETHER // hop * hop
        total = np.zeros((len(texts), FILTERS))
        most = np.zeros((len(texts), FILTERS), np.float32)
        number = np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            respond, _, starts, counts = self._respond([t for _, t in held])
            pooled = self._pool(respond, starts, counts)
            owner = [i for i, _ in held]
            np.add.at(total, owner, pooled[:, :FILTERS] * np.array(counts)[:, None])
            np.maximum.at(most, owner, pooled[:, FILTERS:])
            np.add.at(number, owner, counts)

        for index, text in enumerate(texts):
            for start in range(0, max(1, len(text)), piece):
                held.append((index, text[start : start + piece + OVERLAP_STEPS * STEP]))
                size += len(held[-1][1])
                if size >= SCORED_TOGETHER:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        features = np.concatenate([total / np.maximum(number, 1)[:, None], most], axis=1)
        return features @ self.out.astype(np.float64) + float(self.base[0]) + self.shift

    def learn(self, texts: list[bytes], labels: np.ndarray, seed: int = 5) -> None:
        """Adam on the logistic loss; the gradient reaches the largest response of each chunk."""
        draw = np.random.default_rng(seed)
        parameters = [self.table, self.first, self.second, self.bias, self.out, self.base]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        turn = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                respond, groups, starts, counts = self._respond([texts[i] for i in chosen])
                place = starts[:, None] + np.stack([respond[s : s + CHUNK_STEPS].argmax(axis=0) for s in starts])
                raw = np.take_along_axis(respond, place, axis=0) + self.bias
                chunks = np.maximum(raw, 0)
                owner = np.repeat(np.arange(len(chosen)), counts)
                begin = np.cumsum(counts) - counts
                size = np.array(counts)[:, None]
                largest = np.maximum.reduceat(chunks, begin, axis=0)
                features = np.concatenate([np.add.reduceat(chunks, begin, axis=0) / size, largest], axis=1)
                error = (sigmoid(features @ self.out + self.base[0]) - labels[chosen]).astype(np.float32) / len(chosen)
                top = chunks == largest[owner]
                top = top / np.add.reduceat(top, begin, axis=0)[owner]
                spread = error[owner][:, None] * (self.out[:FILTERS] / size[owner] + self.out[FILTERS:] * top) * (raw > 0)
                here, after = self.table[groups[place]], self.table[groups[place + 1]]
                shape = (*place.shape, STEP * DIMENSIONS)
                gradients = [
                    np.zeros_like(self.table),
                    np.einsum("cfd,cf->df", here.reshape(shape), spread),
                    np.einsum("cfd,cf->df", after.reshape(shape), spread),
                    spread.sum(axis=0), error @ features, np.array([error.sum()], np.float32),
                ]
                for half, where in ((self.first, groups[place]), (self.second, groups[place + 1])):
                    push = (spread[..., None] * half.T[None]).reshape(-1, DIMENSIONS)
                    np.add.at(gradients[0], where.ravel(), push)
                turn += 1
                for p, g, (mean, square) in zip(parameters, gradients, moments):
                    mean += 0.1 * (g - mean)
                    square += 0.001 * (g * g - square)
                    p -= RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)


def fit(sample: Sample) -> ByteNet:
    """Learns from four fifths of the sample; the cut that suits the rest best becomes
    ``CUT``. A sample without both classes gives a constant score near 0 or 1; without any
    row it is a half."""
    net = ByteNet()
    if len(sample.labels) == 0 or sample.labels.min() == sample.labels.max():
        net.constant = 0.0 if not len(sample.labels) else 4.0 if sample.labels[0] else -4.0
        return net
    fits = ~sample.calibrates
    if len(np.unique(sample.labels[fits])) < 2 or len(np.unique(sample.labels[~fits])) < 2:
        fits = np.ones(len(sample.labels), bool)
    judged = ~fits if not fits.all() else fits
    net.learn([t for t, use in zip(sample.texts, fits) if use], sample.labels[fits])
    logits = net.logits([t for t, use in zip(sample.texts, judged) if use])
    net.shift = -best_cut(logits, sample.labels[judged], sample.weights[judged])
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ByteNet:
    return fit(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows))


def scored(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row; null texts count as empty."""

    def run(texts: list[bytes]) -> dict:
        return {"score": (pa.float64(), sigmoid(net.logits(texts)))}

    made = map_texts(docs, run, "score double")
    return made.select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
