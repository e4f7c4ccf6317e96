"""Near-duplicate vectors by E8 lattice hashing."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import lattice
from llm.common import UnionFind, columns, components, small, stage
from llm.textops import GOLDEN, mix
from llm.vectors import matrix

TABLES, BLOCKS, PROBES, SCALE = 12, 2, 2, 0.7  # a pair at cosine 0.98 is missed with probability 6e-5
BLOCK_ROWS = 1024


@functools.lru_cache(maxsize=8)
def _projections(size, tables, blocks, scale):
    rng = np.random.default_rng(size * 1_000_003 + tables)
    return rng.normal(size=(tables, size, blocks * 8)) * scale, rng.random((tables, blocks * 8)) * 2


def _key(seed, table, points):
    """Hash of doubled lattice points (whole numbers), label and table."""
    key = mix(seed + np.uint64((table + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
    for i in range(points.shape[1]):
        key = mix(key * GOLDEN + np.rint(2 * points[:, i]).astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def cells(unit, seed, tables=TABLES, blocks=BLOCKS, probes=PROBES, scale=SCALE):
    """Own cell (n, tables) and neighbouring cells (n, tables * probes) of unit vectors. A cell is ``blocks`` E8 points;
    the neighbours differ by the lattice's shortest vectors that point most towards the vector."""
    weights, shifts = _projections(unit.shape[1], tables, blocks, scale)
    around = lattice.roots()
    own = np.empty((len(unit), tables), np.int64)
    near = np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        y = unit @ weights[t] + shifts[t]
        points = np.concatenate([lattice.nearest(y[:, 8 * b:8 * b + 8]) for b in range(blocks)], axis=1)
        own[:, t] = _key(seed, t, points)
        gain = np.concatenate([(y - points)[:, 8 * b:8 * b + 8] @ around.T for b in range(blocks)], axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            moved = points.copy()
            for b in range(blocks):
                mine = best[:, p] // len(around) == b
                moved[mine, 8 * b:8 * b + 8] += around[best[mine, p] % len(around)]
            near[:, t, p] = _key(seed, t, moved)
    return own, near.reshape(len(unit), -1)


def _lists(values):
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


NAMES = ["vec_id", "label", "print", "unit", "own", "near"]


def _prepare(batches):
    for batch in batches:
        ids, label = batch.column("vec_id"), batch.column("label")
        usable = ids.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
        left = np.ones(len(ids), bool)
        for rows, x in matrix(batch.column("vector")):
            rows, x = rows[usable[rows]], x[usable[rows]]
            left[rows] = False
            for at in range(0, len(rows), 4096):
                take = pa.array(rows[at:at + 4096])
                own = x[at:at + 4096]
                unit = own / np.abs(own).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                prints = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in own]
                labels = label.take(take)
                seed = mix(labels.to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(x.shape[1] << 40))
                home, near = cells(unit, seed)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), labels, pa.array(prints, pa.binary()), pa.array([v.tobytes() for v in unit], pa.binary()),
                     _lists(home), _lists(near)], NAMES)
        rest = pa.array(np.flatnonzero(left))
        nothing = [pa.nulls(len(rest), kind) for kind in (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([ids.take(rest), label.take(rest), *nothing], NAMES)


def _table(column, width):
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _compare(least):
    """One block pair of a cell: (a, b, 0) for links that join groups, (a, null, n) for a's linked vectors counted here.
    A pair that meets in several cells counts only in the first one."""
    def run(key, table):
        cell, i, j = (k.as_py() for k in key)
        node = table.column("node").to_numpy()
        weight = table.column("weight").to_numpy()
        block = table.column("own_block").to_numpy()
        unit = np.stack([np.frombuffer(v) for v in table.column("unit").to_pylist()])
        own = _table(table.column("own"), TABLES)
        near = _table(table.column("near"), TABLES * PROBES).reshape(-1, TABLES, PROBES)
        one = np.flatnonzero(block == i)
        two = np.flatnonzero(block == j)
        forest, counts, edges = UnionFind(len(node)), np.zeros(len(node), np.int64), []
        for at in range(0, len(one), 128):
            rows = one[at:at + 128]
            a, b = np.nonzero(unit[rows] @ unit[two].T >= least)
            a, b = rows[a], two[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            same = own[a] == own[b]
            into_b = (own[a][:, :, None] == near[b]).any(2)
            into_a = (own[b][:, :, None] == near[a]).any(2)
            first = (same | into_b | into_a).argmax(1)
            n = np.arange(len(a))
            same, into_b, into_a = same[n, first], into_b[n, first], into_a[n, first]
            home_a, home_b = own[a, first], own[b, first]
            place = np.where(same, home_a, np.where(into_b & into_a, np.minimum(home_a, home_b), np.where(into_b, home_a, home_b)))
            here = place == cell
            a, b = a[here], b[here]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            for x, y in zip(a.tolist(), b.tolist()):
                if forest.join(x, y):
                    edges.append((node[x], node[y]))
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        some = np.flatnonzero(counts)
        return pa.table([
            pa.array(np.concatenate([a, node[some]])),
            pa.concat_arrays([pa.array(b), pa.nulls(len(some), pa.int64())]),
            pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[some]]))], ["a", "b", "n"])
    return run


def near_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least=0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: links join vectors of equal labels and lengths whose cosine (in
    doubles) is at least ``least``.

    1. One pass projects each vector into ``TABLES`` x ``BLOCKS`` E8 lattices: its own cell, and the nearest cells.
       Equal vectors of a label are one class and are not compared with each other.
    2. Cells with a single visitor are dropped. The others are compared in blocks of about ``BLOCK_ROWS`` rows:
       a large cell is split, no pair of rows is written, only counts and links that join groups.
    3. Counts are summed; union-find rounds give the components.

    Null, empty or zero vectors, vectors with a null or non-finite component, and vectors with a null label link with
    nothing: n_links 0, their own component. Repeated rows count as vectors of their own. Rows without id neither link
    nor count, and have no component; they are kept. An empty table gives no rows."""
    label = F.col("label").cast("long")
    if dict(vectors.dtypes)[label_col] not in ("tinyint", "smallint", "int", "bigint"):
        label = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    rows = columns(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), label.alias("label"))
    sketch = stage(rows.mapInArrow(
        _prepare, "vec_id long, label long, print binary, unit binary, own array<long>, near array<long>"))
    good = sketch.where("print IS NOT NULL")
    classes = stage(good.groupBy("label", "print").agg(
        F.min(F.struct("vec_id", "unit", "own", "near")).alias("x"), F.count("*").alias("weight"))
        .select("label", "print", F.col("x.vec_id").alias("node"), "weight", "x.unit", "x.own", "x.near"))

    visits = classes.select("node", F.explode("own").alias("cell"), F.lit(1).alias("home")).unionByName(
        classes.select("node", F.explode("near").alias("cell"), F.lit(0).alias("home")))
    busy = stage(visits.groupBy("cell").agg(F.sum("home").alias("home"), F.count("*").alias("n"))
                 .where("home > 0 AND n > 1").select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    at = visits.join(small(busy), "cell").withColumn("own_block", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    placed = at.select("node", "cell", "own_block", F.explode(F.expr(
        "transform(sequence(0, blocks - 1), x -> struct(least(own_block, x) AS i, greatest(own_block, x) AS j))")).alias("p")) \
        .select("node", "cell", "own_block", "p.i", "p.j")
    full = placed.join(classes.select("node", "weight", "unit", "own", "near"), "node")
    found = stage(full.groupBy("cell", "i", "j").applyInArrow(_compare(least), "a long, b long, n long"))

    counts = stage(found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links")))
    edges = found.where("b IS NOT NULL").select("a", "b")
    comps = stage(components(edges))
    whole = classes.select("label", "print", "node", "weight") \
        .join(small(counts.withColumnRenamed("a", "node")), "node", "left").join(small(comps), "node", "left")
    whole = stage(whole.select("label", "print", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                               F.coalesce("component", "node").alias("component_id")))
    return sketch.select("vec_id", "label", "print").join(whole, ["label", "print"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
