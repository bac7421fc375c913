"""A bounded sample of labelled rows for the classifiers, and what they share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out


@dataclass
class Sample:
    texts: list[bytes]
    languages: list[str]
    labels: np.ndarray
    #: How many labelled rows one row of the sample stands for.
    weights: np.ndarray
    #: Rows that only calibrate; the others are learned from.
    calibrates: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int) -> Sample:
    """At most ``rows`` documents, half of each class, chosen by a hash of the id among those
    that are labelled and not held out. Of repeated ids one row is taken; null labels and
    ids are left out. The sample may be empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(rows // 2) for k in (0, 1)]
    # ``rows`` ids and labels at most, so their size is bounded
    few = F.broadcast(chosen[0].unionByName(chosen[1]).dropDuplicates(["doc_id"]))
    lang: Column = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), lang.alias("lang"))
    found = source.join(few, "doc_id").dropDuplicates(["doc_id"]).withColumn("h", order).orderBy("h", "doc_id").toArrow().to_pydict()
    y = np.array(found["label"], np.int64)
    taken = np.bincount(y, minlength=2)
    weight = np.array([totals.get(k, 0) / max(1, taken[k]) for k in (0, 1)])
    calibrates = np.array([h % 5 == 0 for h in found["h"]], bool)
    return Sample([bytes(t) for t in found["text"]], [x or "" for x in found["lang"]], y, weight[y] if len(y) else np.zeros(0), calibrates)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, start: float = 0.0) -> float:
    """The cut with the best weighted F1, midway between neighbouring logits of different
    rows; ``start`` if a class is missing."""
    if not len(logits) or labels.min() == labels.max():
        return start
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hit, flagged = np.cumsum(w * y), np.cumsum(w)
    last = np.r_[z[1:] != z[:-1], True]
    f1 = np.where(last, 2 * hit / (flagged + (w * y).sum()), -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    at = best[len(best) // 2]
    return float(z[at] - 0.5 if at == len(z) - 1 else (z[at] + z[at + 1]) / 2)
