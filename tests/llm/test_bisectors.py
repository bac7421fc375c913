"""Centroid clustering against the plain definition."""

import hashlib
import math
import random

import numpy as np
import pytest

from pairloom.llm import bisectors

SCHEMA = "vec_id long, embedding array<float>"


def plain_clusters(rows, k, rounds, seed, width):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(axis) // len(vs) for axis in zip(*vs)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((str(i), j, d, inertia[j], sum(inertia.values()), tuple(centroids[j])) for i, j, d in found))


def clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def test_matches_the_definition_with_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) + i % 5 for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [1.0] * 6) for i in range(150)] + [(7, rows[7][1]), (7, [0.5] * 6), (None, [0.25] * 6)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (905, [float("nan")] * 6), (906, [float("inf")] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA + ", cluster int, key string")
    assert clusters(bisectors.cluster(frame, k=9, rounds=4, dimensions=6)) == plain_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 9, 4, bisectors.SEED, 6)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i), 0.0]) for i in range(n)]
    got = clusters(bisectors.cluster(spark.createDataFrame(rows, SCHEMA), k=5, dimensions=2))
    assert got == plain_clusters(rows, 5, bisectors.ROUNDS, bisectors.SEED, 2)


def test_all_alike_goes_to_the_smaller_number(spark):
    rows = [(i, [2.0] * 4) for i in range(50)]
    assert {r[1] for r in clusters(bisectors.cluster(spark.createDataFrame(rows, SCHEMA), k=8, dimensions=4))} == {0}


def test_large_numbers_stay_exact(spark):
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(2**20)) for _ in range(3)]) for i in range(60)] + [(99, [2.0**22, -(2.0**22), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters(bisectors.cluster(frame, k=6, dimensions=3)) == plain_clusters(rows, 6, bisectors.ROUNDS, bisectors.SEED, 3)


def test_tournament_breaks_ties_like_the_definition():
    draw = random.Random(1)
    for k in (1, 2, 3, 7, 40):
        centroids = [[draw.randrange(-3, 4) for _ in range(3)] for _ in range(k)]
        vectors = np.array([[draw.randrange(-3, 4) for _ in range(3)] for _ in range(400)], float)
        number, distance = bisectors.Tournament(centroids).nearest(vectors)
        for v, j, d in zip(vectors.astype(int).tolist(), number, distance):
            assert (d, j) == min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
