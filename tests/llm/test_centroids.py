import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from llm.centroids import LONGEST, cluster, nearest

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    *[T.StructField(n, T.StringType()) for n in ("vector", "cluster", "distance", "inertia", "sums", "col", "pos", "label", "h")]])


def frame(spark, data):
    return spark.createDataFrame([r + ("x",) * 9 for r in data], SCHEMA).repartition(3)


def plain(data, k, rounds, size):
    kept = [(i, [max(-2 ** 40, min(2 ** 40, math.floor(256 * x))) for x in v]) for i, v in data
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = sum(d for d, _ in found)
    return sorted(((i, j, min(d, LONGEST), min(sum(min(e, LONGEST) for e, c in found if c == j), LONGEST),
                    min(sum(min(e, LONGEST) for e, _ in found), LONGEST) if inertia > LONGEST else inertia,
                    hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, found)), key=str)


def check(spark, data, k=6, rounds=5, size=8):
    got = cluster(frame(spark, data), k=k, rounds=rounds, size=size)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(data, k, rounds, size)


def some(n=150, size=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, size))
    return [(i, (centres[i % 9] + rng.normal(size=size) * .3).tolist()) for i in range(n)]


def test_equals_a_plain_loop(spark):
    data = some()
    v = data[3][1]
    check(spark, data + [(500, None), (501, []), (502, v[:7]), (503, v + [1.0]), (504, [None] + v[1:]), (505, [math.nan] + v[1:]),
                         (506, [math.inf] + v[1:]), (3, v), (3, v), (None, v), (None, v[::-1]), (507, [0.0] * 8)])


def test_ties_and_equal_centroids(spark):
    check(spark, [(i, [float(i % 3)] * 8) for i in range(40)], k=12)   # equal first centroids: the smaller number has the vectors
    check(spark, [(i, [float(x == i % 4) for x in range(8)]) for i in range(40)], k=5, rounds=1)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, some(4), k=6)
    assert cluster(frame(spark, [(1, None)]), k=3, size=8).count() == 0
    assert cluster(frame(spark, []), k=3, size=8).count() == 0


def test_large_components(spark):
    check(spark, some(30) + [(900, [1e9] * 8), (901, [-1e9] + [0.5] * 7), (902, [1e300] * 8), (903, [-1e300, 1e5] + [0.0] * 6)], k=4, rounds=2)


def test_the_walk_finds_the_nearest_with_ties_to_the_smaller_number():
    rng = np.random.default_rng(7)
    for width, k in ((3, 50), (9, 700), (5, 40)):
        x, c = rng.integers(-width, width, (300, 4)), rng.integers(-width, width, (k, 4))
        number, distance = nearest(x, c)
        all_ = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_the_walk_stops_early():
    from llm import centroids as module

    rng = np.random.default_rng(8)
    c = rng.integers(-10 ** 6, 10 ** 6, (2000, 2))
    x = c[:100] + 1
    steps = []
    order = np.argsort(c, axis=0, kind="stable")
    lists = np.take_along_axis(c, order, 0)

    class Counted(np.ndarray):
        def __getitem__(self, at):
            steps.append(1)
            return super().__getitem__(at)
    number, _ = module._walk(x, c, order.view(Counted), lists)
    assert len(steps) < 100 and (c[number] == c[:100]).all()
