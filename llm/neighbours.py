"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import columns, stage
from llm.vectors import matrix

SAMPLE = 4096      # vectors that the partitions and the classifier are learned from
PART_ROWS = 16384  # rows of a partition: their number grows with the table, up to an eighth of the sample
MASSES = (0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999)  # tried for how far a query goes
RECALL = 0.96      # of the mass that is taken, on vectors that nothing was learned from
BASE_ROWS = 16384  # of a block: 8 MB of 64 components


def neighbour_graph(x, near=16):
    """Indices of each row's nearest rows by inner product."""
    near = min(near, len(x) - 1)
    out = np.empty((len(x), near), np.int64)
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at:at + 512] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    return out


def balanced_parts(x, graph, parts, rounds=12, slack=1.1):
    """Split the nodes of the graph into ``parts`` of nearly equal size with few cut edges: halve along main axes,
    then let nodes move to the part of most of their neighbours while it has room."""
    n = len(x)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        fresh = part * 2
        for p in range(count):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            centred = x[own] - x[own].mean(0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = np.argsort(centred @ axis, kind="stable")
            fresh[own[order[len(own) // 2:]]] += 1
        part, count = fresh, count * 2
    part %= parts
    limit = int(np.ceil(n / parts * slack))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < limit:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A one-layer network from a vector to the partitions' probabilities."""

    def __init__(self, weights, scale):
        self.weights, self.scale = weights, scale

    def probabilities(self, x):
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x / self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def learn(x, parts, hidden=64, steps=400, seed=3):
    """The router for sample ``x``: its targets are the partitions of each vector and of its neighbours."""
    n, d = x.shape
    parts = max(1, min(parts, n // 8))
    scale = max(float(np.abs(x).max()), 1e-300)
    y = x / scale
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden)
    w2, b2 = rng.normal(size=(hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)
    weights = [w1, b1, w2, b2]
    if parts == 1:
        return Router(weights, scale)
    graph = neighbour_graph(y)
    part = balanced_parts(y, graph, parts)
    target = np.zeros((n, parts))
    target[np.arange(n), part] += 1
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    target /= target.sum(1, keepdims=True)
    spread = max(float(np.sqrt((y ** 2).mean())), 1e-300)
    w1 /= spread
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        rows = rng.integers(0, n, min(n, 512))
        inp = y[rows]
        h = np.maximum(inp @ w1 + b1, 0)
        z = h @ w2 + b2
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - target[rows]) / len(rows)
        dh = (dz @ w2.T) * (h > 0)
        grads = [inp.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
        for i, (w, g) in enumerate(zip(weights, grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            pace = 0.01 * (spread ** -1 if i == 0 else 1)
            w -= pace * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-12)
    return Router(weights, scale)


def choose_mass(router, x, k, masses=MASSES, recall=RECALL, queries=512):
    """The least of ``masses`` at which queries find ``recall`` of their nearest rows, measured on ``x``, vectors that the router was
    not fitted on; 1, which leaves out nothing, if none does."""
    if len(x) <= k + 1:
        return 1.0
    p = router.probabilities(x)
    home = p.argmax(1)
    near = neighbour_graph(x / max(float(np.abs(x).max()), 1e-300), k)[:queries]
    order = np.argsort(-p[:queries], axis=1, kind="stable")
    sorted_ = np.take_along_axis(p[:queries], order, 1)
    before = np.empty_like(sorted_)
    np.put_along_axis(before, order, np.cumsum(sorted_, axis=1) - sorted_, 1)   # the probability of those visited earlier
    at = np.take_along_axis(before, home[near], 1)
    return next((m for m in masses if (at < m).mean() >= recall), 1.0)


def _clean(batches):
    """Usable vectors as bytes of doubles, with their length."""
    for batch in batches:
        for rows, x in matrix(batch.column("vector")):
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)),
                pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "size", "vector"])


def _route(routers, masses=None, rows=None, k=0):
    """Partitions of each vector: the most probable one, or, with ``masses`` (by length), as many as reach the length's mass and
    hold more than ``k`` rows (``rows``: those of each partition, by length)."""
    def run(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            vectors = batch.column("vector").to_pylist()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in routers:  # no vector of this length was in the sample
                    visits, which = np.arange(len(at)), np.zeros(len(at), np.int64)
                else:
                    p = routers[size].probabilities(np.stack([np.frombuffer(vectors[i]) for i in at]))
                    order = np.argsort(-p, axis=1, kind="stable")
                    chosen = np.zeros(p.shape, bool)
                    if masses is not None:
                        sorted_, held = np.take_along_axis(p, order, 1), rows[size][order]
                        chosen = (np.cumsum(sorted_, axis=1) - sorted_ < masses[size]) | (np.cumsum(held, axis=1) - held <= k)
                    chosen[:, 0] = True
                    visits, place = np.nonzero(chosen)
                    which = order[visits, place]
                take = pa.array(at[visits])
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(take), batch.column("size").take(take), pa.array(which.astype(np.int32)),
                    batch.column("vector").take(take)], ["vec_id", "size", "part", "vector"])
    return run


def _nearest(asked, ids, x, k):
    """(query ids, row ids, scores) of the ``k`` best of the rows (ids in order, vectors) for each query, itself excepted."""
    q, v, s = [], [], []
    for at in range(0, len(asked[0]), 256):
        own = asked[0][at:at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = asked[1][at:at + 256] @ x.T
        scores[own[:, None] == ids[None, :]] = -np.inf
        few = min(k, len(ids))
        floor = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
        for i, one in enumerate(own):
            best = np.flatnonzero((scores[i] >= floor[i]) & (ids != one))
            best = best[np.argsort(-scores[i][best], kind="stable")][:k]   # ties by id, as the rows are in that order
            q.append(np.full(len(best), one))
            v.append(ids[best])
            s.append(scores[i][best])
    return [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in ((q, np.int64), (v, np.int64), (s, float))]


def _best(k):
    """Rows in order of block, a block's own rows before its queries -> the ``k`` best rows of the block for each query. A task holds
    one block's rows at a time; its queries stream by."""
    def run(batches):
        block, ids, x = None, None, None
        held_ids, held = [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("size", "part", "block")], axis=1)
            query, vec = batch.column("query").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy()
            vectors = batch.column("vector")
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for first, last in zip(starts, np.r_[starts[1:], len(keys)]):
                if block != (key := tuple(keys[first].tolist())):
                    block, ids, held_ids, held = key, None, [], []
                ends = first + int(np.count_nonzero(~query[first:last]))
                data = np.frombuffer(b"".join(vectors.slice(first, last - first).to_pylist())).reshape(last - first, -1)
                if ends > first:
                    held_ids.append(vec[first:ends])
                    held.append(data[:ends - first])
                if ends == last or not held:
                    continue
                if ids is None:
                    order = np.argsort(np.concatenate(held_ids), kind="stable")
                    ids, x = np.concatenate(held_ids)[order], np.concatenate(held)[order]
                    held_ids, held = [ids], [x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in _nearest((vec[ends:last], data[ends - first:]), ids, x, k)], ["query_id", "vec_id", "score"])
    return run


def neighbours(vectors: DataFrame, queries, k=20, id_col="vec_id", vector_col="embedding", part_rows=PART_ROWS, sample=SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row that the condition
    ``queries`` (on the id) selects, the row itself excepted; ties go to the smaller id.

    1. A sample of ``sample`` vectors, the first by hash of the id, gives a neighbour graph, its balanced partitioning,
       and a small classifier of partitions (fitted on the driver: the sample is bounded). There are as many partitions as
       ``part_rows`` asks for, up to an eighth of the sample. As many further vectors, nothing of which was learned, measure
       how much probability a query must visit to find its neighbours (``choose_mass``): where vectors are clustered that is
       little, where they lie evenly most partitions.
    2. The classifier puts every row into its most probable partition; nothing is left out.
    3. A query goes to its most probable partitions up to that mass, and on until these hold more than ``k`` rows. A partition
       is dealt into blocks of about ``BASE_ROWS`` rows, each shipped once; a task holds one block while its queries stream
       by. The best of all blocks are merged.

    Rows with a null id, or vectors that are null, empty, zero or hold a null or non-finite component take no part.
    Vectors are compared with those of their own length. Of queries that repeat an id, the smallest vector asks;
    repeated rows are results of their own. An empty table gives no rows."""
    rows = columns(vectors, vec_id=id_col, vector=vector_col).where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    base = stage(rows.mapInArrow(_clean, "vec_id long, size int, vector binary"))
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(2 * sample).collect()
    total = dict(base.groupBy("size").count().collect())   # a row for each length of vectors
    routers, masses = {}, {}
    for size in {r["size"] for r in drawn}:
        own = np.stack([np.frombuffer(bytes(r["vector"])) for r in drawn if r["size"] == size])
        half = own[:sample] if len(own) > sample else own[:-(-len(own) // 2)]
        if len(half) >= 16:
            parts = min(1 << max(0, int(total[size] - 1) // part_rows).bit_length(), len(half) // 8)
            routers[size] = learn(half, parts)
            masses[size] = choose_mass(routers[size], own[len(half):], k)
    schema = "vec_id long, size int, part int, vector binary"
    indexed = stage(base.mapInArrow(_route(routers), schema))
    counts = indexed.groupBy("size", "part").count().collect()   # partitions: bounded by the sample
    held = {size: np.zeros(router.weights[3].shape[0], np.int64) for size, router in routers.items()}
    for r in counts:
        if r["size"] in held:
            held[r["size"]][r["part"]] = r["count"]
    asked = base.where(queries).groupBy("vec_id", "size").agg(F.min("vector").alias("vector"))
    asked = asked.mapInArrow(_route(routers, masses, held, k), schema)
    if not counts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.broadcast(vectors.sparkSession.createDataFrame(
        [(r["size"], r["part"], -(-r["count"] // BASE_ROWS)) for r in counts], "size int, part int, blocks int"))
    placed = indexed.join(blocks, ["size", "part"]).select(
        "size", "part", F.expr("CAST(pmod(xxhash64(vec_id, vector), blocks) AS int)").alias("block"), F.lit(False).alias("query"), "vec_id", "vector")
    visits = asked.join(blocks, ["size", "part"]).select(
        "size", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("query"), "vec_id", "vector")
    key = ["size", "part", "block"]
    sorted_ = placed.unionByName(visits).repartition(*key).sortWithinPartitions(*key, "query")
    found = sorted_.mapInArrow(_best(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
