"""Random forests, all trees of all cells grown from binned rows, a group of trees a task.

The trees are Spark ML's: limits of at most ``BINS`` bins a feature from a sample of ``SAMPLE`` rows, a bootstrapped number of each
row (Poisson), the root of the number of features drawn for each node, the split of the largest Gini gain, down to single rows, and
sister leaves of one prediction merged; the random draws are other ones. A cell's rows become a byte a feature, and equal ones are
one with a weight (the number drawn of w equal rows is Poisson of w), so that a task holds a whole cell and grows its trees without
a job a level. Cells of more than ``BYTES`` such bytes are not grown here.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memsight.session import stage

SEED = 42
BINS, SAMPLE = 32, 10_000   # as Spark ML's
BYTES = 256 << 20   # of a cell's binned rows, which a task holds
BLOCK = 1 << 16     # rows that travel as one
DEALT = 200_000     # rows of a task that sorts binned rows
CHUNK, NODES = 1 << 15, 1024   # rows and nodes whose histograms are made together
TASKS = 3           # a core


def limits(values):
    """Limits between the bins of one feature: between all its values, or at the steps of equal numbers of rows."""
    value, count = np.unique(values, return_counts=True)
    middles = (value[:-1] + value[1:]) / 2
    if len(middles) < BINS:
        return middles
    upto, step = np.cumsum(count), len(values) / BINS
    out, target = [], step
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middles[i - 1])
            target += step
    return np.array(out)


def _matrix(column):
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _limits_of(group):
    """Limits of all features of a cell's sample, and how many each has."""
    x = _matrix(group.column("values").combine_chunks())
    found = [limits(x[:, f]) for f in range(x.shape[1])]
    return pa.table({"cell": group.column("cell")[:1].cast(pa.int32()),
                     "limits": pa.array([np.concatenate(found)], pa.list_(pa.float64())), "sizes": pa.array([[len(a) for a in found]], pa.list_(pa.int32()))})


def _binned(cuts):
    """Rows as cell, positive, and a byte a feature, the number of limits below its value."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, cell = _matrix(batch.column("values")), batch.column("cell").to_numpy()
            if not np.isfinite(x).all():
                raise ArithmeticError("a feature of the forests' rows is not finite")
            bins = np.empty(x.shape, np.uint8)
            for c in np.unique(cell):
                own = cell == c
                for f, cut in enumerate(cuts[c]):
                    bins[own, f] = np.searchsorted(cut, x[own, f])
            ends = np.arange(n + 1, dtype=np.int32) * x.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("positive"), packed], ["cell", "positive", "bins"])
    return run


def _blocks(width):
    """Binned rows (cell, positive, bins, n), ordered by cell, as packed blocks of one cell: cell, at (their order), rows, data."""
    def packed(part, at, cell, held):
        bins, positive, n = (np.concatenate(a) for a in zip(*held))
        data = bins.tobytes(order="F") + positive.astype(np.uint8).tobytes() + n.astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([(part << 32) + at], pa.int64()), pa.array([len(n)], pa.int32()),
             pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], ["cell", "at", "rows", "data"])

    def run(batches):
        part, at, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            column = batch.column("bins")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
            bins = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, width)
            positive, n = batch.column("positive").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            for c in np.unique(cell):
                if held and (c != now or size >= BLOCK):
                    yield packed(part, at, now, held)
                    at, held, size = at + 1, [], 0
                own, now = cell == c, int(c)
                held.append((bins[own], positive[own], n[own]))
                size += int(own.sum())
        if held:
            yield packed(part, at, now, held)
    return run


def _opened(data, rows, width):
    raw = pa.decompress(data, rows * (width + 9), "zstd", asbytes=True)
    bins = np.frombuffer(raw, np.uint8, rows * width).reshape(width, rows).T
    return bins, np.frombuffer(raw, np.uint8, rows, rows * width), np.frombuffer(raw, np.int64, rows, rows * (width + 1))


def _splits(x, positive, drawn, order, starts, total, chosen, bins):
    """Best split of each of some nodes: (feature or -1, bin). ``order``: their rows, one node's after the other's, from ``starts``;
    ``total``: drawn rows of each class; ``chosen``: the features of each node that are tried."""
    nodes, tried = chosen.shape
    sums = np.zeros((tried, nodes * bins * 2))
    node = np.repeat(np.arange(nodes), np.diff(starts))
    for a in range(0, len(order), CHUNK):
        own, at = order[a:a + CHUNK], node[a:a + CHUNK]
        rows, base = x[own].ravel(), np.arange(len(own)) * x.shape[1]
        key, weight, feature = at * (2 * bins) + positive[own], drawn[own], chosen[at]
        first, last = at[0], at[-1] + 1   # only these nodes have rows here
        key -= first * 2 * bins
        for j in range(tried):
            found = np.bincount(key + 2 * rows[base + feature[:, j]].astype(np.int64), weight, (last - first) * 2 * bins)
            sums[j, first * 2 * bins:last * 2 * bins] += found
    sums = sums.reshape(tried, nodes, bins, 2)
    no, yes = (np.cumsum(sums[:, :, :-1, k], axis=2) for k in (0, 1))   # to the left of each limit
    other_no, other_yes = (total[None, :, None, k] - left for k, left in enumerate((no, yes)))
    here, there = no + yes, other_no + other_yes
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (no * no + yes * yes) / here + (other_no * other_no + other_yes * other_yes) / there
    score[(here == 0) | (there == 0)] = -1
    flat = score.transpose(1, 0, 2).reshape(nodes, -1)
    best = flat.argmax(1)
    size = total.sum(1)
    gain = flat[np.arange(nodes), best] - (total ** 2).sum(1) / size
    feature, at = chosen[np.arange(nodes), best // (bins - 1)], best % (bins - 1)
    return np.where(gain > 1e-9 * size, feature, -1), at


def grow(x, positive, weight, bins, seed, depth, least=0):
    """One tree of binned rows: feature (-1: a leaf), bin, left, right, and the drawn rows of both classes; parents come before
    children, sister leaves of one prediction are merged, and nodes of fewer than ``least`` drawn rows are not split.
    ``positive``: 0 or 1; ``bins``: the most bins of a feature."""
    rng = np.random.default_rng(seed)
    drawn = rng.poisson(weight).astype(float)
    order = np.flatnonzero(drawn)
    width = x.shape[1]
    tried = math.ceil(math.sqrt(width))
    whole = np.bincount(positive[order], drawn[order], 2)
    feature, limit, left, right, counts = [np.array([-1])], [np.array([0])], [np.array([-1])], [np.array([-1])], [whole[None, :]]
    starts, ids, made = np.array([0, len(order)]), np.array([0]), 1
    if bins < 2 or not whole.all():
        ids = ids[:0]
    for _ in range(depth):
        if not len(ids):
            break
        total = counts[-1][ids - (made - len(counts[-1]))]   # all of the last level
        found, cut = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        for a in range(0, len(ids), NODES):
            b = min(a + NODES, len(ids))
            chosen = rng.random((b - a, width)).argpartition(tried - 1, axis=1)[:, :tried]
            found[a:b], cut[a:b] = _splits(x, positive, drawn, order[starts[a]:starts[b]], starts[a:b + 1] - starts[a], total[a:b], chosen, bins)
        split = found >= 0
        n = int(split.sum())
        node = np.repeat(np.arange(len(ids)), np.diff(starts))
        stays = split[node]
        order, node = order[stays], (np.cumsum(split) - 1)[node[stays]]
        ids, found, cut = ids[split], found[split], cut[split]
        for held, value in ((feature, found), (limit, cut), (left, made + 2 * np.arange(n)), (right, made + 2 * np.arange(n) + 1)):
            _put(held, ids, value)
        child = 2 * node
        for a in range(0, len(order), CHUNK):
            own, at = order[a:a + CHUNK], node[a:a + CHUNK]
            child[a:a + CHUNK] += x[own, found[at]] > cut[at]
        both = np.bincount(2 * child + positive[order], drawn[order], 4 * n).reshape(2 * n, 2)
        for held, value in ((feature, -1), (limit, 0), (left, -1), (right, -1)):
            held.append(np.full(2 * n, value))
        counts.append(both)
        goes = both.all(axis=1)   # to the next level: both classes are left
        order, child = order[goes[child]], child[goes[child]]
        # rows by child, in their order: those of a node lie together already
        first = child & 1
        size = np.bincount(child, minlength=2 * n)
        begin = np.cumsum(size) - size
        ones = np.cumsum(first) - first
        zeros = np.arange(len(child)) - ones
        pair = child >> 1
        ones_before = np.concatenate([[0], np.cumsum(size[1::2])])[pair]
        zeros_before = np.concatenate([[0], np.cumsum(size[::2])])[pair]
        at = begin[child] + np.where(first == 1, ones - ones_before, zeros - zeros_before)
        sorted_order = np.empty_like(order)
        sorted_order[at] = order
        order = sorted_order
        ids = made + np.flatnonzero(goes)
        starts = np.concatenate([[0], np.cumsum(size[goes])])
        made += 2 * n
    return _pruned(*(np.concatenate(a) for a in (feature, limit, left, right, counts)), least)


def _put(held, ids, value):
    """Sets nodes of the last level."""
    held[-1][ids - (sum(map(len, held)) - len(held[-1]))] = value


def _pruned(feature, limit, left, right, counts, least):
    """Sister leaves of one prediction are merged, from the leaves up; then children of nodes of fewer than ``least`` rows go."""
    level, levels = np.array([0]), []
    while len(level):
        levels.append(level)
        inner = level[feature[level] >= 0]
        level = np.concatenate([left[inner], right[inner]])
    says = counts[:, 1] > counts[:, 0]
    for level in reversed(levels):
        inner = level[feature[level] >= 0]
        a, b = left[inner], right[inner]
        same = inner[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]
        feature[same] = -1
    feature[counts.sum(1) < least] = -1
    kept, level = [], np.array([0])
    while len(level):
        kept.append(level)
        inner = level[feature[level] >= 0]
        level = np.concatenate([left[inner], right[inner]])
    kept = np.sort(np.concatenate(kept))
    number = np.full(len(feature), -1)
    number[kept] = np.arange(len(kept))
    inner = feature[kept] >= 0
    return (feature[kept].astype(np.int32), np.where(inner, limit[kept], 0).astype(np.int32), np.where(inner, number[left[kept]], -1).astype(np.int32),
            np.where(inner, number[right[kept]], -1).astype(np.int32), counts[kept])


def _grown(plan, sizes, widest, width, depth, least):
    """Blocks of one task -> its trees. ``plan``: task -> (cell, first tree, tree after the last one)."""
    def run(batches):
        task, blocks = TaskContext.get().partitionId(), []
        for batch in batches:
            blocks += zip(batch.column("at").to_pylist(), batch.column("rows").to_pylist(), batch.column("data").to_pylist())
        if not blocks:
            return
        cell, begin, end = plan[task]
        n, at = sizes[cell], 0
        x, positive, weight = np.empty((n, width), np.uint8), np.empty(n, np.uint8), np.empty(n, np.int64)
        for _, rows, data in sorted(blocks, key=lambda b: b[0]):
            x[at:at + rows], positive[at:at + rows], weight[at:at + rows] = _opened(data, rows, width)
            at += rows
        del blocks
        for tree in range(begin, end):
            feature, limit, left, right, counts = grow(x, positive, weight, widest[cell], [SEED, tree], depth[cell], least[cell])
            data = [a.tobytes() for a in (feature, limit, left, right, counts[:, 0].astype(np.int64), counts[:, 1].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([tree], pa.int32()), *[pa.array([d], pa.binary()) for d in data]],
                ["cell", "tree", "feature", "limit", "left", "right", "negative", "positive"])
    return run


def fit_forests(train: DataFrame, trees, depth, least) -> dict:
    """cell -> (feature, limit, left, right, negative, positive, roots), nodes of its trees as arrays, for each cell in ``trees`` (cell
    -> their number) whose binned rows are at most ``BYTES``. ``train``: cell (a number), sid, t_predict, class, values, staged;
    ``depth`` and ``least`` by cell: the most levels of splits, and the least drawn rows of a node that is split."""
    spark = train.sparkSession
    train = train.filter(F.col("cell").isin(list(trees)))
    facts = {r.cell: r for r in train.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("values")).alias("width")).collect()}
    if set(facts) != set(trees):
        raise ValueError("a forest needs rows")
    width = max(r.width for r in facts.values())
    share = F.element_at(F.create_map(*[F.lit(v) for c, r in facts.items() for v in (c, min(1.0, SAMPLE / r.n))]), F.col("cell"))
    picked = F.pmod(F.xxhash64("sid", "t_predict", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30)
    found = train.filter(picked).select("cell", "values").groupBy("cell").applyInArrow(_limits_of, "cell int, limits array<double>, sizes array<int>")
    cuts = {r.cell: np.split(np.array(r.limits), np.cumsum(r.sizes)[:-1]) for r in found.collect()}   # at most BINS numbers a cell and feature
    for c in set(facts) - set(cuts):
        cuts[c] = [np.zeros(0)] * width
    binned = train.select("cell", (F.col("class") == 1).alias("positive"), "values").mapInArrow(_binned(cuts), "cell int, positive boolean, bins binary")
    keys = ["cell", "positive", "bins"]
    parts = math.ceil(sum(r.n for r in facts.values()) / DEALT)
    merged = binned.groupBy(*keys).agg(F.count("*").alias("n")).repartition(parts, *keys).sortWithinPartitions(*keys)
    blocks = stage(merged.mapInArrow(_blocks(width), "cell int, at long, rows int, data binary"))
    sizes = {r.cell: r.n for r in blocks.groupBy("cell").agg(F.sum("rows").alias("n")).collect()}
    own = [c for c in trees if sizes[c] * width <= BYTES]
    if not own:
        return {}
    wanted = TASKS * spark.sparkContext.defaultParallelism / sum(sizes[c] * trees[c] for c in own)
    pieces = {c: min(trees[c], max(1, round(wanted * sizes[c] * trees[c]))) for c in own}
    plan = [(c, trees[c] * i // pieces[c], trees[c] * (i + 1) // pieces[c]) for c in own for i in range(pieces[c])]
    plan.sort(key=lambda p: sizes[p[0]] * (p[2] - p[1]), reverse=True)   # the longest start first
    numbers = spark.createDataFrame([(p[0], i) for i, p in enumerate(plan)], "cell int, task int")
    dealt = blocks.join(F.broadcast(numbers), "cell").repartitionById(len(plan), F.col("task")).select("at", "rows", "data")
    widest = {c: 1 + max(len(a) for a in cuts[c]) for c in own}
    schema = "cell int, tree int, feature binary, limit binary, left binary, right binary, negative binary, positive binary"
    table = dealt.mapInArrow(_grown(plan, sizes, widest, width, depth, least), schema).toArrow().sort_by([("cell", "ascending"), ("tree", "ascending")])
    out = {}
    for c in own:
        rows = table.filter(pc.equal(table["cell"], c))
        kinds = {"feature": np.int32, "limit": np.int32, "left": np.int32, "right": np.int32, "negative": np.int64, "positive": np.int64}
        held = {k: [np.frombuffer(v, kind) for v in rows[k].to_pylist()] for k, kind in kinds.items()}
        roots = np.cumsum([0, *map(len, held["feature"])])[:-1]
        feature, at = np.concatenate(held["feature"]), np.concatenate(held["limit"])
        first = np.cumsum([0, *map(len, cuts[c])])
        flat = np.concatenate([*cuts[c], [0.0]])
        limit = np.where(feature >= 0, flat[np.where(feature >= 0, first[feature] + at, 0)], 0.0)
        left, right = (np.concatenate([np.where(v >= 0, v + r, -1).astype(np.int32) for v, r in zip(held[k], roots)]) for k in ("left", "right"))
        out[c] = feature, limit, left, right, np.concatenate(held["negative"]), np.concatenate(held["positive"]), roots
    return out
