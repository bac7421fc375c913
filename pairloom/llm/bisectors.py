"""Centroid clustering with nearest centroids found by a tournament of bisectors.

The points that are as near to centroid i as to centroid j lie on ``n . x = t`` with the
integer normal ``n = 2 (c_j - c_i)`` and threshold ``t = |c_j|^2 - |c_i|^2``. So one sign
tells which of two centroids loses a vector, and k - 1 signs leave the nearest; zero
favours the smaller number. A distance is computed once, to the winner.

The numbers of a vector and of the centroids are integers and all sums are exact: in
doubles where a bound shows that no sum can reach 2**53, else in Python's integers. So
the result depends neither on partitions nor on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Below it doubles add integers exactly.
EXACT = 2**53


def whole_vectors(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and ``floor(SCALE * x)`` of these, in doubles.

    Usable is a list of exactly ``dimensions`` components, none null or not finite.
    """
    right = np.asarray(column.value_lengths().fill_null(-1)) == dimensions
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan"))).reshape(-1, dimensions)
    finite = np.isfinite(values).all(axis=1)
    usable = np.flatnonzero(right)[finite]
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values[finite])
    if len(scaled) and np.abs(scaled).max() >= 2.0**63:
        raise ArithmeticError("a component does not fit a long")
    return usable, scaled


def bisectors(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Normals ``[i, j]`` and thresholds ``[i, j]`` of all pairs i < j, as Python integers."""
    c = np.array(centroids, dtype=object)
    k = len(centroids)
    normals, thresholds = np.zeros((k, k, c.shape[1]), object), np.zeros((k, k), object)
    squares = [int(row @ row) for row in c]
    for i in range(k):
        for j in range(i + 1, k):
            normals[i, j], thresholds[i, j] = 2 * (c[j] - c[i]), squares[j] - squares[i]
    return normals, thresholds


class Tournament:
    """The nearest of a few centroids for many vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, dtype=object)
        self.normals, self.thresholds = bisectors(centroids)
        self.reach = int(np.abs(self.normals).max())
        self.offset = int(np.abs(self.thresholds).max())
        self.largest = int(np.abs(self.centroids).max())
        if self.reach * self.normals.shape[2] < EXACT and self.offset < EXACT:
            self.fast = self.normals.astype(np.float64), self.thresholds.astype(np.float64), self.centroids.astype(np.float64)

    def _numbers(self, vectors: np.ndarray):
        """Vectors, normals, thresholds and centroids in a type whose sums are exact."""
        most, width = int(np.abs(vectors).max()), vectors.shape[1]
        if max(most * self.reach * width + self.offset, width * (most + self.largest) ** 2) < EXACT:
            return vectors, *self.fast
        return np.array([[int(x) for x in row] for row in vectors], object), self.normals, self.thresholds, self.centroids

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, of each row."""
        if not len(vectors):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        x, normals, thresholds, centroids = self._numbers(vectors)
        entered = list(range(len(centroids)))
        while len(entered) > 1:
            left = []
            for first, second in zip(entered[::2], entered[1::2]):
                # whoever came from further left has the smaller number
                value = (x * normals[first, second]).sum(axis=1) - thresholds[first, second]
                left.append(np.where(value > 0, second, first))
            entered = left + entered[len(entered) - len(entered) % 2 :]
        winner = np.broadcast_to(entered[0], len(x))
        gap = x - centroids[winner]
        distance = (gap * gap).sum(axis=1)
        if int(distance.max()) >= 2**63:
            raise ArithmeticError("a squared distance does not fit a long")
        return winner.astype(np.int64), distance.astype(np.int64)


def _prepared(vectors: DataFrame, key: str, column: str) -> DataFrame:
    return vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))


def first_centroids(vectors: DataFrame, key: str, column: str, k: int, seed: int, dimensions: int) -> list[list[int]]:
    """The usable vectors of the ``k`` smallest hashes of ``seed:key``, in that order."""
    source = _prepared(vectors, key, column)
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, scaled = whole_vectors(batch.column(1), dimensions)
            rows = pa.array([[int(v) for v in row] for row in scaled], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), rows], names=["key", "vector"])

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    usable = source.select("key", "vector").mapInArrow(run, f"key {kind}, vector array<bigint>")
    return [list(r.vector) for r in usable.select(draw.alias("draw"), "vector").orderBy("draw", "vector").limit(k).collect()]


def _moved(source: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Every centroid at the floor of its vectors' mean; those without vectors stay.

    A task sends one row of sums for each centroid, whatever the number of its vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        totals, counts = {}, {}
        for batch in batches:
            _, scaled = whole_vectors(batch.column(0), dimensions)
            number, _ = tournament.nearest(scaled)
            exact = len(scaled) == 0 or float(np.abs(scaled).max()) * len(scaled) < EXACT
            for c in np.unique(number):
                mine = scaled[number == c]
                sums = mine.sum(axis=0).astype(np.int64).tolist() if exact else [sum(map(int, axis)) for axis in mine.T]
                totals[c] = [a + b for a, b in zip(totals.get(c, [0] * dimensions), sums)]
                counts[c] = counts.get(c, 0) + len(mine)
        decimals = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array(list(totals.values()), decimals)], names=["cluster", "n", "sums"]
        )

    parts = source.select("vector").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("axis", "part")).groupBy("cluster", "axis")
    moved = [list(c) for c in centroids]
    for r in wide.agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():  # k * dimensions rows
        moved[r.cluster][r.axis] = int(r.total) // r.n
    return moved


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, key: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid)`` of every usable row.

    A vector is usable if it has exactly ``dimensions`` components, none null or not
    finite; others have no row. Components become ``floor(256 * x)``. The first centroids
    are the vectors of the smallest hashes of the key (a null key hashes as empty text,
    rows of one key go by their components); fewer than ``k`` vectors give as many
    centroids, none give an empty table. Repeated rows are rows of their own. Only the key
    and the vector are read, so other columns may have any name. Components or distances
    beyond a long are an error.

    Each round reads the vectors once and sends sums of at most ``k`` centroids from each
    task; the driver holds ``k`` centroids. The last assignment is written to the shared
    folder, since its totals stand beside every row.
    """
    source = _prepared(vectors, key, column)
    kind = source.schema["key"].dataType.simpleString()
    centroids = first_centroids(vectors, key, column, k, seed, dimensions)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(source, centroids, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids) if centroids else None
        for batch in batches:
            usable, scaled = whole_vectors(batch.column(1), dimensions)
            if len(usable):
                number, distance = tournament.nearest(scaled)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), pa.array(number, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    assigned, _ = written(source.mapInArrow(run, f"key {kind}, cluster int, distance long"), "assigned")
    by_cluster = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, int(t), list(map(int, centroids[c]))) for c, t in by_cluster.items()]  # k at most
    totals = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid array<bigint>")
    joined = assigned.join(F.broadcast(totals), "cluster").withColumn("inertia", F.lit(int(sum(by_cluster.values()))).cast("long"))
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: str = "centroid"):
    """Lower-case hex SHA-256 of a centroid's decimal components, comma-joined."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)
