"""Helpers of the operators: size-checked broadcasts, staged tables, row keys and connected components."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memsight.operators.joins import estimated_bytes
from memsight.session import stage

BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 1 << 20  # of a table's files, a few times that in memory; larger tables are joined by a shuffle

__all__ = ["stage", "small", "fresh", "bounded_batches", "tidy", "columns", "components", "union_find"]


def small(df: DataFrame, limit=BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer bounds its size by ``limit`` bytes (for a staged table: its files), else as
    it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def fresh(df: DataFrame, *names):
    """Names that ``df`` has no columns of, for columns of a table that it is joined with."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark, limit=BATCH_BYTES):
    """Arrow batches of this session hold at most ``limit`` bytes from here on, if its own bound is not lower: a task and its
    Python worker hold a few batches of whole texts at a time, and workers are reused with what memory they took."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, str(limit)))
    if own <= 0 or own > limit:
        spark.conf.set(key, str(limit))


def tidy(run):
    """``run``, a function for mapInArrow, that gives freed memory back to the system at the end of a task: its Python worker
    is reused by the tasks of later stages, and what it keeps adds up."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # where the C library has it
            if trim:
                trim(0)
    return tidied


def columns(df: DataFrame, **named) -> DataFrame:
    """Only the named columns, under new names, so that further columns of any name cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in named.items()])


class UnionFind:
    """Union by smallest id over ids 0..n-1."""

    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a, b):
        """True if a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def union_find(a, b):
    """Edges as arrays -> (node, smallest node of its group) for all nodes but the smallest ones."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = UnionFind(len(ids))
    for x, y in zip(index[:len(a)].tolist(), index[len(a):].tolist()):
        forest.join(x, y)
    roots = np.array([forest.find(i) for i in range(len(ids))], np.int64)
    mine = roots != np.arange(len(ids))
    return ids[mine], ids[roots[mine]]


EDGE_BATCH = 1 << 18  # edges that a task contracts at once: 4 MB


def _contract(limit):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= limit:
                yield _edges(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield _edges(*map(np.concatenate, zip(*held)))
    return run


def _edges(a, b):
    nodes, roots = union_find(a, b)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def components(edges: DataFrame, batch=EDGE_BATCH) -> DataFrame:
    """Edges (a, b), longs in any order -> (node, component): the smallest node reachable, for every node but
    the smallest ones themselves.

    Edges that fit one batch are united by one union-find. Else rounds: union-find within batches of each task, which
    makes stars of groups; every node hangs itself and its other roots on its smallest root (a map-side combined
    aggregation), then on that root's own root (a join that adaptive execution can split). Every round is staged; the
    rounds end when no node has two roots and no root has one."""
    edges = stage(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
                  .where("a <> b"))
    contract = _contract(batch)
    if edges.limit(batch + 1).count() <= batch:
        united = stage(edges.coalesce(1).mapInArrow(tidy(contract), "a long, b long"))
        return united.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        stars = edges.mapInArrow(tidy(contract), "a long, b long")
        # a task gives a node one root for each batch, so the set is small
        roots = stage(stars.groupBy("a").agg(F.collect_set("b").alias("roots")).withColumn("m", F.array_min("roots")))
        upper = small(roots.select(F.col("a").alias("m"), F.col("m").alias("up")))
        hung = stage(roots.join(upper, "m", "left").select(
            "a", F.coalesce("up", "m").alias("b"), "roots", (F.col("up").isNotNull() | (F.size("roots") > 1)).alias("open")))
        if not hung.where("open").limit(1).count():
            return hung.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = hung.select("a", "b").unionByName(
            hung.where("size(roots) > 1").select(F.explode("roots").alias("a"), "b").where("a <> b"))
