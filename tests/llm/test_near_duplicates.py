import random
import re
from collections import Counter

import numpy as np
import pytest

from awkward import AWKWARD, table
from llm import common, near_duplicates as module
from llm.near_duplicates import keep_one, near_duplicates
from llm.superminhash import signatures


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent=80):
    """(doc_id, size of the set, component, kept) of rows with an id."""
    sets = [(i, shingle_set(t, k)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i), find(i) == i) for i, s in sets)


def near_copies(seed=3, groups=12):
    """Groups of texts with random edits: pairs of a group are above, at and below the threshold."""
    rng, rows, n = random.Random(seed), [], 0
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 20, 60]))]
        for _ in range(rng.choice([1, 2, 9, 25])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                words[rng.randrange(len(words))] = rng.choice(["X", "y", f"z{rng.randint(0, 9)}"])
            rows.append((n, " ".join(w.upper() if rng.random() < .1 else w for w in words), "s"))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,block", [(2, 400_000), (5, 60)])
def test_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(module, "BLOCK_SHINGLES", block)
    rows = near_copies() + AWKWARD
    got = near_duplicates(table(spark, rows), shingle=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == brute(rows, k)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0


def test_keep_one(spark):
    rows = near_copies(5, 6) + AWKWARD + [(904, "same text here", "c")]
    docs = table(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c, k in brute(rows, 5) if k}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)  # each once, also of repeated rows
    assert ids.count(None) == 2


def test_signatures_equal_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    from llm.textops import GOLDEN, mix

    sizes, m = [0, 1, 2, 7, 40, 300], 32
    values = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = signatures(values, bounds, m)
    for i in range(len(sizes)):
        best = [2**64 - 1] * m
        for v in values[bounds[i]:bounds[i + 1]]:
            order = list(range(m))
            for j in range(m):
                x = int(mix(np.array([v]) + np.uint64((j + 1) * int(GOLDEN) & (2**64 - 1)))[0])
                k = j + ((x & 0xFFFFFF) * (m - j) >> 24)
                order[j], order[k] = order[k], order[j]
                best[order[j]] = min(best[order[j]], j << 40 | x >> 24)
        assert got[i].tolist() == best


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 50).astype(np.uint64)])
    sig = signatures(np.concatenate([a, b]), np.array([0, 500, 1000]), 252)
    assert abs((sig[0] == sig[1]).mean() - 450 / 550) < .08


@pytest.mark.parametrize("batch", [40, 1 << 18])
def test_components(spark, batch):
    rng = np.random.default_rng(4)
    edges = rng.integers(0, 300, (220, 2))
    edges = np.concatenate([edges, [[500 + i, 501 + i] for i in range(30)], [[900, i] for i in range(800, 860)]])
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")
    keep = edges[:, 0] != edges[:, 1]
    nodes, roots = common.union_find(edges[keep, 0], edges[keep, 1])
    got = {r.node: r.component for r in common.components(df, batch).collect()}
    assert got == dict(zip(nodes.tolist(), roots.tolist()))
    assert common.components(df.where("false"), batch).count() == 0
