"""Clusters against all distances in every round."""

import hashlib
import random

import numpy as np
import pytest

from spendalloc.llm import centroids as c

from .data import result

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, first long, n string, centroid string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5, "y", "z") for i, v in rows], SCHEMA).repartition(5)


def brute(rows, k, rounds, scale, seed=3):
    rows = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is None, digest(r[0]), np.array(r[1], "<i4").tobytes()))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            cents[j] = [sum(col) // len(g) for col in zip(*g)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    total = sum(inertia.values())
    return sorted(((i, j, d, inertia[j], total, cents[j]) for i, j, d in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def check(spark, rows, kept=None, **how):
    got = result(c.centroid_clusters(table(spark, rows), **how), *COLUMNS)
    want = brute(rows if kept is None else kept, how["k"], how["rounds"], how["scale"])
    assert got == want


@pytest.mark.parametrize("k,rounds,scale", [(5, 6, 1024), (12, 4, 7), (1, 2, 1024), (3, 0, 1024)])
def test_against_all_distances(spark, k, rounds, scale):
    r = random.Random(k)
    middles = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(middles)]) for i in range(400)]
    check(spark, rows, k=k, rounds=rounds, dims=4, scale=scale)


def test_ties_copies_null_ids_and_fewer_vectors_than_centroids(spark):
    """Small whole numbers make many equal distances and equal centroids."""
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(2)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [1.0, 1.0]), (None, [0.0, 2.0]), (None, [0.0, -2.0])] + [(900 + i, [1.0, 0.0]) for i in range(80)]
    check(spark, rows, k=9, rounds=5, dims=2, scale=1)
    check(spark, rows[:3], k=8, rounds=3, dims=2, scale=1)
    check(spark, [(None, [0.0, 2.0])], k=2, rounds=2, dims=2, scale=1)


def test_left_out_vectors(spark):
    good = [(1, [0.5, -0.25]), (2, [0.1, 0.2])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]),
           (9, [float("inf"), 1.0]), (10, [float("-inf"), 1.0])]
    check(spark, good + bad, good, k=2, rounds=2, dims=2, scale=1024)
    assert c.centroid_clusters(table(spark, bad), k=2, rounds=2, dims=2).count() == 0
    assert c.centroid_clusters(spark.createDataFrame([], SCHEMA), k=2, rounds=2, dims=2).count() == 0


def test_bounds_leave_out_distances_without_changing_results(monkeypatch):
    """Rounds after the first look at few centroids, and the search alone equals all distances."""
    r = np.random.default_rng(4)
    middles = r.integers(-4000, 4000, (40, 8))
    x = middles[r.integers(0, 40, 3000)] + r.integers(-60, 60, (3000, 8))
    now = x[r.permutation(3000)[:40]]
    counted = []
    plain = c.squared
    monkeypatch.setattr(c, "squared", lambda a, b: counted.append(len(a)) or plain(a, b))
    state, before = (None,) * 4, None
    for round_ in range(6):
        places = c.Places(now, before)
        counted.clear()
        state = c.step(x, *state, places)
        every = np.stack([plain(x, m) for m in now], 1)
        assert (state[0] == every.argmin(1)).all()
        before, now = now, np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any()
                                     else now[j] for j in range(40)])
        if round_:
            assert sum(counted) < 0.35 * 40 * len(x)
