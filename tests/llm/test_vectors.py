from collections import defaultdict

import numpy as np
from pyspark.sql import types as T

from llm import lattice, near_vectors as near_module, neighbours as neighbours_module
from llm.near_vectors import near_vectors
from llm.neighbours import neighbours

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("node", "cell", "part", "size", "vector", "n", "weight", "rank")]])


def rows(n=400, seed=1, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, size))
    out = []
    for i in range(n):
        v = centres[i % 20] + rng.normal(size=size) * (.06 if i % 2 else .8)
        out.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    out += [(5000, out[1][1], out[1][2]), (5001, out[1][1], out[1][2]), (5001, out[1][1], out[1][2]), (5002, out[1][1], None),
            (5003, None, 1), (5004, [0.0] * size, 1), (5005, [float("nan")] + [1.0] * (size - 1), 1), (5006, [None] + [1.0] * (size - 1), 1),
            (5007, [], 1), (5020, [1.0, 2.0], 1), (5040, [2.0, 4.0], 1), (None, out[1][1], out[1][2])]
    return out


def frame(spark, data):
    return spark.createDataFrame([r + ("x",) * 8 for r in data], SCHEMA).repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest(x)
    assert len(lattice.roots()) == 240 and np.allclose((lattice.roots() ** 2).sum(1), 2)
    doubled = 2 * p
    assert np.allclose(doubled, np.rint(doubled)) and np.allclose(p.sum(1) % 2, 0)
    around = p[:, None] + lattice.roots()[None]
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - around) ** 2).sum(2) + 1e-9).all()


def brute_links(data, least=.98):
    links, parent = defaultdict(int), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, np.array(v, float) / np.linalg.norm(v), l) for i, v, l in data if i is not None and l is not None and usable(v)]
    for i, _, _ in good:
        parent[i] = i
    for n, (i, a, l) in enumerate(good):
        for j, b, k in good[:n]:
            if l == k and len(a) == len(b) and a @ b >= least:
                links[n] += 1
                links[[m for m, g in enumerate(good) if g[0] == j and g[1] is b][0]] += 1
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return good, links, find


def check(spark, data):
    got = near_vectors(frame(spark, data)).collect()
    assert len(got) == len(data)
    good, links, find = brute_links(data)
    by = {r.vec_id: r for r in got}
    for n, (i, _, _) in enumerate(good):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (links[n], find(i), find(i) == i), i
    linked = {i for i, _, _ in good}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in linked)
    return by


def test_links_equal_brute_force(spark):
    by = check(spark, rows())
    assert by[5001].n_links >= 3 and by[5002].n_links == 0 and by[5040].component_id == 5020


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_module, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    check(spark, [(i, [float(np.float32(x)) for x in base + rng.normal(size=16) * .05], 1) for i in range(70)])


def test_no_vectors(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert neighbours(frame(spark, []), "vec_id % 20 = 0").count() == 0


def test_neighbours(spark):
    data = rows(1200)
    got = defaultdict(list)
    for r in neighbours(frame(spark, data), "vec_id % 20 = 0", k=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v, _ in data if i is not None and usable(v)]
    hit = total = 0
    queries = {i: v for i, v in good if i % 20 == 0}
    for q, v in queries.items():
        others = [(-(u @ v), i) for i, u in good if i != q and len(u) == len(v)]
        want = sorted(others)[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = defaultdict(list)
        for s, i in others:
            exact[i].append(-s)
        assert all(min(abs(s - e) for e in exact[i]) < 1e-9 for _, i, s in found)
        hit += len({i for _, i in want} & {i for _, i, _ in found})
        total += len({i for _, i in want})
    assert set(got) == {q for q in queries if len([1 for i, u in good if i != q and len(u) == len(queries[q])])}
    assert hit / total >= .9


def recall(spark, data, **options):
    got = defaultdict(set)
    for r in neighbours(frame(spark, data), "vec_id % 20 = 0", k=20, **options).collect():
        got[r.query_id].add(r.vec_id)
    ids, x = np.array([i for i, _, _ in data]), np.array([v for _, v, _ in data])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort([ids, -s])[:20]].tolist())
        assert len(got[ids[q]]) == 20
        hit, total = hit + len(want & got[ids[q]]), total + 20
    return hit / total


def test_recall_at_two_sizes_and_on_clustered_vectors(spark, monkeypatch):
    seen, choose = [], neighbours_module.choose_mass
    monkeypatch.setattr(neighbours_module, "choose_mass", lambda router, *a: seen.append((len(router.weights[3]), choose(router, *a))) or seen[-1][1])
    rng = np.random.default_rng(11)
    even = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    centres = rng.normal(size=(60, 24)) * 3
    tight = [(i, (centres[i % 60] + rng.normal(size=24) * .15).tolist(), 1) for i in range(3000)]
    long_ = [(i, (np.array(v) * (1 + 50 * (i % 7 == 0))).tolist(), 1) for i, v, _ in even]
    assert recall(spark, even[:1000], part_rows=128) >= .9 and recall(spark, even, part_rows=128) >= .9
    assert [n for n, _ in seen] == [8, 32]       # partitions grow with the rows
    assert recall(spark, tight, part_rows=128) >= .9
    assert seen[2][1] < seen[1][1]               # and clustered vectors are found in fewer of them
    assert recall(spark, long_, part_rows=128) >= .9


def test_a_query_goes_on_until_it_has_seen_enough_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours_module, "choose_mass", lambda *a: 0.0)
    rng = np.random.default_rng(3)
    recall(spark, [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(400, 16)))], part_rows=8)


def test_blocks_of_a_partition(spark, monkeypatch):
    monkeypatch.setattr(neighbours_module, "BASE_ROWS", 50)
    rng = np.random.default_rng(4)
    assert recall(spark, [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(700, 16)))], part_rows=1 << 20) == 1
