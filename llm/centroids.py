"""Centroid clustering of whole-number vectors; the nearest centroid comes from the threshold algorithm."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import columns, stage

MOST = 1 << 40          # larger components count as this, so that sums of a batch stay within 64 bits
NARROW = 1 << 26        # components up to this have squared distances of 64 bits in up to 256 dimensions
LONGEST = (1 << 63) - 1
ROWS = 1024             # vectors that are walked together


def _walk(x, centroids, order, lists):
    n, d = x.shape
    k, dims = len(centroids), np.arange(x.shape[1])
    right = np.stack([np.searchsorted(lists[:, j], x[:, j]) for j in dims], axis=1)  # the first value not below
    left = right - 1
    best, number = np.zeros(n, x.dtype), np.full(n, -1)
    seen = np.zeros((n, k), bool)
    on = np.arange(n)
    while len(on):
        own, low, high = x[on], left[on], right[on]
        below = own - lists[np.maximum(low, 0), dims]
        above = lists[np.minimum(high, k - 1), dims] - own
        down = (low >= 0) & ((high >= k) | (below <= above))
        frontier = np.where(down, below, above)
        met = order[np.where(down, low, high), dims]
        left[on], right[on] = low - down, high + ~down

        fresh = np.zeros((len(on), k), bool)
        fresh[np.arange(len(on))[:, None], met] = True
        fresh &= ~seen[on]
        seen[on] |= fresh
        row, which = np.nonzero(fresh)
        if len(row):
            exact = ((own[row] - centroids[which]) ** 2).sum(1)
            start = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(exact, start)
            # the smallest number of those at the least distance: numbers ascend within a row
            at = np.flatnonzero(exact == np.repeat(least, np.diff(start, append=len(row))))
            at = at[np.diff(row[at], prepend=-1) > 0]
            mine = on[row[at]]
            better = (number[mine] < 0) | (least < best[mine]) | ((least == best[mine]) & (which[at] < number[mine]))
            best[mine[better]], number[mine[better]] = least[better], which[at][better]
        threshold = (frontier ** 2).sum(1)
        on = on[(threshold <= best[on]) & ~seen[on].all(1)]
    return number, best


def nearest(x, centroids):
    """(number, squared distance) of the nearest centroid of each row of ``x``, whole numbers; of equally near ones the
    smallest number.

    Every dimension has a list of the centroids in order of that component. A vector enters each list at its own value
    and walks outward, one centroid a step, the nearer side first; a centroid met for the first time gets its exact
    distance. One not met yet is, in every dimension, at least as far as the walk has come: once the sum of the squared
    frontier distances strictly exceeds the best distance, none can be nearer or equally near."""
    widest = max((int(np.abs(v).max()) for v in (x, centroids) if v.size), default=0)
    if widest > NARROW:  # exact whole numbers of any size
        x, centroids = x.astype(object), centroids.astype(object)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, 0)
    parts = [_walk(x[at:at + ROWS], centroids, order, lists) for at in range(0, len(x), ROWS)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, best = (np.concatenate(p) for p in zip(*parts))
    return number, np.minimum(best, LONGEST).astype(np.int64)


def _usable(size, scale):
    """Whole-number vectors of the rows that have ``size`` components, none null or non-finite."""
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
            if column.null_count:
                sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, -1)
            rows = np.flatnonzero(sizes == size)
            values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            x = values[column.offsets.to_numpy().astype(np.int64)[rows][:, None] + np.arange(size)]
            good = np.isfinite(x).all(1)
            rows, x = rows[good], x[good]
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), _lists(whole)], ["vec_id", "vector"])
    return run


def _lists(values):
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def _vectors(batch, size):
    return batch.column("vector").flatten().to_numpy().reshape(-1, size)


def _sums(centroids):
    """Of each batch and cluster: the count, then the sums of the components."""
    def run(batches):
        for batch in batches:
            x = _vectors(batch, centroids.shape[1])
            number, _ = nearest(x, centroids)
            order = np.argsort(number, kind="stable")
            if not len(order):
                continue
            start = np.flatnonzero(np.diff(number[order], prepend=-1))
            sums = np.add.reduceat(x[order], start, axis=0)
            counts = np.diff(start, append=len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[order][start].astype(np.int32)), _lists(np.column_stack([counts, sums]))], ["cluster", "sums"])
    return run


def _assign(centroids):
    def run(batches):
        for batch in batches:
            number, distance = nearest(_vectors(batch, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, k=40, rounds=5, size=64, scale=256, id_col="vec_id", vector_col="embedding", salt="2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector: those of exactly ``size``
    components, none null or non-finite, as whole numbers floor(scale * x).

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``salt`` and id. Each of ``rounds`` rounds
    assigns every vector to its nearest centroid (``nearest``: the threshold algorithm) and replaces every centroid that
    has vectors by the floor of their mean; then vectors are assigned once more.

    Vectors are read in one pass and staged; a round is one pass over them that hands on a count and component sums for
    each batch and cluster, so a cluster that holds most vectors is no heavy key. The driver sees the ``k`` centroids and
    ``k`` rows of totals.

    Null, short or long vectors, and those with a null or non-finite component, are not kept and have no row. Components
    beyond 2^40 count as 2^40; distances and inertias beyond 64 bits are given as the largest long. Vectors without an
    id take part, but are no first centroid as long as others are left; repeated ids count as vectors of their own, and
    of equal hashes the smaller vector comes first. With fewer vectors than ``k`` there are as many centroids as
    vectors; an empty table gives no rows. Further columns are not read."""
    spark = vectors.sparkSession
    rows = columns(vectors, vec_id=id_col, vector=vector_col).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    kept = stage(rows.mapInArrow(_usable(size, scale), "vec_id long, vector array<long>"))
    first = kept.select("vector", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"))
    first = first.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r.vector for r in first], np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids), "cluster int, sums array<long>").select("cluster", F.posexplode("sums"))
        found = sums.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
        totals = {(r.cluster, r.pos): int(r.total) for r in found}
        for c in {r.cluster for r in found}:
            centroids[c] = [totals[c, j + 1] // totals[c, 0] for j in range(size)]
    assigned = stage(kept.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"))
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    whole = min(sum(int(r.total) for r in found), LONGEST)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r.cluster, min(int(r.total), LONGEST), whole, prints[r.cluster]) for r in found],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
