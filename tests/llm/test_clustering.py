"""Clusters against plain Python: ties, repeats, vectors that are not kept, few vectors, the annulus itself."""

import hashlib
import math
import random

import numpy as np

from tidewell.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def by_hand(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in start[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(cs)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, j in got if j == k) for k in range(len(cs))}
    return [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in got]


def test_cluster(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(rng.choice([0, 0.3]), 0.1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [rng.choice([-0.25, 0.25]) for _ in range(6)]) for i in range(80)]  # many equal distances
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (400, None), (401, []), (402, [0.1] * 5), (403, [0.1] * 7), (404, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (405, [math.nan] * 6), (406, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (407, [0.0] * 6), (408, [-1000.0] * 6)]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], SCHEMA)
    got = clustering.cluster(df.repartition(3), clusters=8, rounds=4, dimensions=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(by_hand(rows, 8, 4, 6), key=repr)


def test_few_and_no_vectors(spark):
    rows = [(i, [0.1 * i] * 3) for i in range(3)]
    df = spark.createDataFrame([(*r, "c", 3) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in clustering.cluster(df, dimensions=3).collect()) == by_hand(rows, 8, 10, 3)
    assert clustering.cluster(df.limit(0), dimensions=3).collect() == [] and clustering.cluster(df, dimensions=64).collect() == []


def test_annulus_with_ties_on_its_edge():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (2000, 2))
    c = rng.integers(-3, 4, (25, 2))
    label, best = clustering.annulus_nearest(x, c)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    far = rng.integers(-(2**27) + 1, 2**27, (500, 64))
    label, best = clustering.annulus_nearest(far, far[:9])
    d = [[sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in far[:9].tolist()] for r in far[:50].tolist()]
    assert label[:50].tolist() == [min(range(9), key=lambda k: (row[k], k)) for row in d] and best[:50].tolist() == [min(row) for row in d]
