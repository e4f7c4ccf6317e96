"""Whole operators against plain simulations that use the same hashes."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from awkward import AWKWARD, table, texts
from pyspark.sql import functions as F

from llm import quality, sharding
from llm.quality import classify_quality
from llm.sharding import shard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    """The surface rates of one text, by plain loops."""
    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, spans = [], []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", lower):
        words.append(m[0])
        spans.append(m.span())
    n, size = max(len(words), 1), max(len(raw), 1)
    pairs = list(zip(words, words[1:])) + [("last", len(words))] * bool(words)   # the last word's pair is its own

    def rate(signs):
        return sum(b in signs for b in raw) / size
    return [math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            len(set(pairs)) / n, rate(b"#$%&*|<>{}[]\\^~_=+@/"), rate(b".,;:!?"), rate(b"!?"), rate(bytes(range(65, 91))), rate(b"0123456789"),
            rate(b"\n"), sum(any(b in b"#$%&*|<>{}[]\\^~_=+@/" for b in raw[s:e]) for s, e in spans) / n, rate(bytes(range(128, 256)))]


def strength(between, within):
    return 1e6 if between is None or between <= within * 1e-6 else min(1e6, max(1.0, within / between))


def posteriors(rows):
    """(host, path) -> (host's rate, path's rate), and the global rate; rows: (host, path, evidence)."""
    p = [(h, q, 1 / (1 + math.exp(-e))) for h, q, e in rows]
    rate = min(max(sum(x for *_, x in p) / len(p), 1e-4), 1 - 1e-4)
    within = rate * (1 - rate)
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, q, x in p:
        hosts[h].append(x)
        paths[h, q].append(x)

    def spread(groups, base, free):
        if len(groups) <= free:
            return None
        return max(0.0, sum(sum(g) ** 2 / len(g) for g in groups) - base - (len(groups) - free) * within) / len(p)
    strong = strength(spread(list(hosts.values()), rate * rate * len(p), 1), within)
    host = {h: (strong * rate + sum(g)) / (strong + len(g)) for h, g in hosts.items()}
    base = sum(sum(g) ** 2 / len(g) for g in hosts.values())
    strong = strength(spread(list(paths.values()), base, len(hosts)), within)
    return {(h, q): (host[h], min(max((strong * host[h] + sum(g)) / (strong + len(g)), 1e-4), 1 - 1e-4)) for (h, q), g in paths.items()}, rate


def test_quality_equals_plain_posteriors(spark):
    made = texts(160, 3) + ["### $$ %% " * (i % 9 + 1) + "11 22 33" for i in range(80)]
    data = AWKWARD + [(i, t, [None, "a", "b", "rare"][(i % 3) + (i % 41 == 0)]) for i, t in enumerate(made)]
    labels = [(i, int(i < 160)) for i in range(240) if i % 4]
    docs = table(spark, data).withColumn("path", F.concat(F.col("source"), F.when(F.col("doc_id") % 5 == 0, "/x").otherwise("/y")))
    got = classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("source"), F.col("path")).collect()
    assert len(got) == len(data)
    at = {r["doc_id"]: (r["source"], r["path"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    x = {i: np.array(features(t), np.float32).astype(float) for i, (_, _, t) in at.items()}
    by_id = {r.doc_id: r for r in got if r.doc_id in at}
    taught = sorted((i, y) for i, y in labels)
    classifier = quality.Classifier.fit(np.array([x[i] for i, _ in taught]), np.array([y for _, y in taught]))
    for i, r in by_id.items():
        assert r.evidence == pytest.approx(classifier.evidence(x[i][None])[0], abs=1e-5), i
    sites = {(r["doc_id"], r["text"]): (r["source"], r["path"]) for r in docs.collect()}
    hashes = {(r["doc_id"], r["h"]): sites[r["doc_id"], r["text"]] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    rows = [(*hashes[r.doc_id, r.hash], r.evidence) for r in got]
    found, rate = posteriors(rows)
    for r, (h, q, e) in zip(got, rows):
        host, path = found[h, q]
        logit = e + math.log(path / (1 - path)) - math.log(rate / (1 - rate))
        assert (r.host_rate, r.path_rate) == pytest.approx((host, path), abs=1e-9)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9) and r.keep == (r.score >= .5)


def simulate(spark, data, shards):
    """Shards of the documents by plain loops over the rounds: (doc_id, size, shard) and slots."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, data).select(
        "doc_id", (F.octet_length(text) + 1).alias("size"), F.xxhash64(text).alias("g"), F.crc32(text).alias("crc"), F.xxhash64("doc_id", text).alias("h"))
    nodes = [r.asDict() | {"own": r.own} for r in rows.withColumn("own", F.xxhash64("h", F.lit(7))).collect()]
    groups = Counter((n["g"], n["crc"]) for n in nodes)
    keys = spark.createDataFrame([(g, c, s) for g, c in groups for s in range(shards)], "g long, crc long, shard int")
    tie = {(r.g, r.shard): r.tie for r in keys.select("g", "shard", F.xxhash64("g", "shard").alias("tie")).collect()}
    order = {(r.g, r.crc): r.o for r in keys.select("g", "crc", F.xxhash64("g", "crc").alias("o")).collect()}
    linked, free = [], []
    for n in nodes:
        (linked if groups[n["g"], n["crc"]] > 1 else free).append(n)
        n["shard"] = n["h"] % shards
    part = sum(n["size"] for n in nodes) / shards
    for _ in range(sharding.ROUNDS):
        capacity, votes = sharding.FILL * part, defaultdict(lambda: [0, 0])
        for n in linked:
            votes[n["g"], n["crc"], n["shard"]][0] += n["size"]
            votes[n["g"], n["crc"], n["shard"]][1] += 1
        has = [sum(b for (_, _, s), (b, _) in votes.items() if s == k) for k in range(shards)]
        goal = {}
        for (g, c, s), (_, n) in votes.items():
            if has[s] < capacity:
                goal[g, c] = max(goal.get((g, c), (-1,)), (n, tie[g, s], s))
        moves = {(g, c, s): goal[g, c][2] for (g, c, s), (_, n) in votes.items() if (g, c) in goal and goal[g, c] > (n, tie[g, s], s)}
        if not moves:
            break
        stays = [sum(b for (g, c, s), (b, _) in votes.items() if s == k and (g, c, s) not in moves) for k in range(shards)]
        wanted, share, before = Counter(), {}, Counter()
        for (g, c, s), to in moves.items():
            wanted[g, c, to] += votes[g, c, s][0]
        for g, c, to in sorted(wanted, key=lambda k: (order[k[0], k[1]], k[0])):
            share[g, c] = max(0.0, min(1.0, (max(0.0, capacity - stays[to]) - before[to]) / wanted[g, c, to]))
            before[to] += wanted[g, c, to]
        for n in linked:
            key = n["g"], n["crc"], n["shard"]
            if key in moves and n["own"] % (1 << 30) / (1 << 30) < share[key[:2]]:
                n["shard"] = moves[key]
    loads = [0] * shards
    for n in sorted(linked, key=lambda n: n["h"]):
        room = loads[n["shard"]] + n["size"] <= part
        loads[n["shard"]] += n["size"]
        n["over"] = not room
    if any(load > part for load in loads):
        free += [n for n in linked if n["over"]]
        linked = [n for n in linked if not n["over"]]
    loads = [sum(n["size"] for n in linked if n["shard"] == s) for s in range(shards)]
    classes = defaultdict(list)
    for n in free:
        classes[max(2, int(math.floor(math.log2(n["size"]) / 2)))].append(n)
    for c in sorted(classes, reverse=True):
        ends, at, done = [], 0.0, 0
        for more in sharding._levelled(loads, sum(n["size"] for n in classes[c]))[:-1]:
            at += more
            ends.append(at)
        for n in sorted(classes[c], key=lambda n: n["h"]):
            n["shard"] = sum(done + n["size"] / 2 >= e for e in ends)
            done += n["size"]
        loads = [load + sum(n["size"] for n in classes[c] if n["shard"] == s) for s, load in enumerate(loads)]
    out = []
    for s in range(shards):
        own = sorted((n for n in nodes if n["shard"] == s), key=lambda n: n["h"])
        out += [(n["doc_id"], n["size"], s, slot) for slot, n in enumerate(own)]
    return Counter(out)


@pytest.mark.parametrize("shards,copies", [(4, 12), (7, 90), (3, 0)])
def test_sharding_equals_a_plain_simulation(spark, shards, copies):
    made = texts(80, 9) + [t for i, t in enumerate(texts(9, 4)) for _ in range(copies * (i % 3))]
    data = AWKWARD + [(i, t, "a") for i, t in enumerate(made)]
    got = Counter((r.doc_id, r["size"], r.shard, r.slot) for r in shard_documents(table(spark, data), shards).collect())
    assert got == simulate(spark, data, shards)
