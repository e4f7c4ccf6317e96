"""Perceptrons, all networks of all cells fitted at once.

A network is a topology of one cell. Its weights minimise the mean cross entropy of the cell's rows by limited-memory BFGS, from
the first weights of Spark ML's perceptron and with its stops. One pass over the rows evaluates every open network at its own
trial point; a network moves on or shortens its step by itself. A pass is one job, hands on a row of sums for each ``PART``
weights of a network and task, and leaves out networks that have ended.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from memsight.operators.bags import _packed, _unpacked
from memsight.session import stage, staging

ITERATIONS, MEMORY, TOLERANCE, WINDOW = 100, 10, 1e-6, 20   # as Spark ML's
TRIALS = 20   # of a step
CHUNK = 1024  # rows that are taken together: what a layer gives them stays in the processor's cache
PART = 64     # weights that are summed as one row
ROWS = 25_000   # of a task of a pass
BYTES = 512 << 20   # of rows that are cached; more are read from a compressed table at each pass
SUMS = f"array({', '.join(f'sum(sums[{j}])' for j in range(PART))}) AS sums"


def shaped(flat, layers):
    """(weights, offsets) of each layer, views of the flat weights in Spark ML's order."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _squash(z):
    np.negative(z, out=z)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def add_loss(flat, layers, x, positive, weight, sums):
    """Adds the rows' weighted loss to ``sums[0]`` and its gradient to the rest."""
    parts, slopes, held = shaped(flat, layers), shaped(sums[1:], layers), [x]
    for w, b in parts[:-1]:
        z = held[-1] @ w
        z += b
        held.append(_squash(z))
    w, b = parts[-1]
    z = held[-1] @ w + b
    gap = np.where(positive, z[:, 0] - z[:, 1], z[:, 1] - z[:, 0])   # of the wrong class over the right one
    sums[0] += weight @ np.logaddexp(0, gap)
    pull = weight * np.exp(-np.logaddexp(0, -gap))
    d = np.stack([np.where(positive, pull, -pull), np.where(positive, -pull, pull)], axis=1)
    for i in range(len(parts) - 1, -1, -1):
        slopes[i][0][...] += held[i].T @ d
        slopes[i][1][...] += d.sum(0)
        if i:
            d = d @ parts[i][0].T
            d *= held[i]
            d *= 1 - held[i]


def _evaluate(nets, trial):
    """Rows of a task -> net, part, sums: loss and gradient of the open networks. ``nets``: (cell, layers); ``trial``: net -> weights."""
    own = {}
    for net in trial:
        own.setdefault(nets[net][0], []).append(net)

    def run(batches):
        sums = {net: np.zeros(-(-(1 + len(flat)) // PART) * PART) for net, flat in trial.items()}
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch.column("cell").to_numpy()
                x, weight = _unpacked(batch.column("values")), batch.column("weight").to_numpy()
                positive = batch.column("class").to_numpy() == 1
                for c in np.unique(cell):
                    rows = np.flatnonzero(cell == c)
                    for at in range(0, len(rows), CHUNK):
                        some = rows[at:at + CHUNK]
                        some_x, some_positive, some_weight = x[some], positive[some], weight[some]
                        for net in own.get(c, ()):
                            flat = trial[net]
                            add_loss(flat, nets[net][1], some_x, some_positive, some_weight, sums[net][:1 + len(flat)])
        for net, total in sums.items():
            n = len(total) // PART
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * PART, total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, net, np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists], ["net", "part", "sums"])
    return run


def _pass(rows, nets, trial, sizes):
    """net -> (mean loss, gradient) at the weights ``trial[net]``, by one job. ``sizes``: rows of each cell."""
    parts = rows.mapInArrow(_evaluate(nets, trial), "net int, part int, sums array<double>")
    total = parts.groupBy("net", "part").agg(F.expr(SUMS)).toArrow()
    total = total.combine_chunks().sort_by([("net", "ascending"), ("part", "ascending")])   # as many numbers as there are weights
    net, sums = total["net"].to_numpy(), total["sums"].combine_chunks().flatten().to_numpy().reshape(-1, PART)
    out = {}
    for n, flat in trial.items():
        own = sums[net == n].ravel() / sizes[nets[n][0]]
        out[n] = own[0], own[1:1 + len(flat)]
    return out


def _direction(g, steps):
    """Minus the inverse curvature times the gradient, by the two-loop recursion."""
    q, kept = -g, []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q = q - a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q = q * ((s @ y) / (y @ y))
    for (s, y), a in zip(steps, reversed(kept)):
        q = q + (a - (y @ q) / (s @ y)) * s
    return q


def _step(x, f, slope, d, t):
    """Tries steps along ``d`` until one meets the strong Wolfe conditions; (point, loss, gradient) of it, else of the lowest, else None."""
    low, high, best = (0.0, f, slope), None, None
    for _ in range(TRIALS):
        at = x + t * d
        f2, g2 = yield at
        along = g2 @ d
        if not np.isfinite(f2) or f2 > f + 1e-4 * t * slope or f2 >= low[1]:
            high = t, f2, along
        else:
            best = at, f2, g2
            if abs(along) <= -0.9 * slope:
                break
            if along * ((np.inf if high is None else high[0]) - low[0]) >= 0:
                high = low
            low = t, f2, along
        if high is None:
            t *= 2
            continue
        wide = high[0] - low[0]
        bend = 2 * (high[1] - low[1] - low[2] * wide)   # of the parabola through low, its slope, and high
        share = -low[2] * wide / bend if np.isfinite(bend) and bend > 0 else 0.5
        t = low[0] + min(max(share, 0.1), 0.9) * wide
    return best


def minimise(x, iterations=ITERATIONS):
    """Yields the points whose (loss, gradient) it is then sent; returns the last one."""
    f, g = yield x
    if not (np.isfinite(f) and np.isfinite(g).all()):
        raise ArithmeticError("a feature of the networks' rows is not finite")
    first, past, steps = f, [f], []
    for _ in range(iterations):
        if np.linalg.norm(g) <= max(TOLERANCE * f, 1e-8):
            break
        d = _direction(g, steps)
        if d @ g >= 0:
            d, steps = -g, []
        found = yield from _step(x, f, d @ g, d, 1.0 if steps else 1 / np.linalg.norm(d))
        if found is None and steps:   # once more without what the steps have told
            d, steps = -g, []
            found = yield from _step(x, f, d @ g, d, 1 / np.linalg.norm(d))
        if found is None:
            break
        s, y = found[0] - x, found[2] - g
        steps = [*steps, (s, y)][-MEMORY:] if s @ y > 0 else steps
        x, f, g = found
        past = [*past, f][-WINDOW:]
        if max(past) - f <= TOLERANCE * first:
            break
    return x


def fit_networks(train: DataFrame, nets, starts) -> list:
    """Flat weights of each network in ``nets``: (cell, layers), from its ``starts``. ``train``: cell (a number), class, values, weight,
    staged; equal rows may be one with a weight. A cell without rows raises."""
    spark = train.sparkSession
    facts = train.groupBy("cell").agg(F.sum("weight").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r.cell: r["size"] for r in facts}
    if any(cell not in sizes for cell, _ in nets):
        raise ValueError("a network needs rows")
    # each task of a pass has rows of all cells: networks of one cell take many times longer than those of another
    cores = spark.sparkContext.defaultParallelism
    parts = math.ceil(sum(r.n for r in facts) / ROWS)
    parts = parts if parts < cores else cores * round(parts / cores)
    dealt = train.select("cell", "class", "values", "weight").repartition(parts, "cell", "class", "values", "weight")
    rows = dealt.mapInArrow(_packed, "cell int, class double, values binary, weight double")
    with staging(spark):
        if sum(r.n for r in facts) * (8 * max(layers[0] for _, layers in nets) + 32) <= BYTES:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            rows = stage(rows, codec="zstd")
        try:
            runs, trial, out = [minimise(np.asarray(s, float)) for s in starts], {}, {}
            for i, run in enumerate(runs):
                trial[i] = next(run)
            while trial:
                for i, found in _pass(rows, nets, trial, sizes).items():
                    try:
                        trial[i] = runs[i].send(found)
                    except StopIteration as end:
                        out[i] = end.value
                        del trial[i]
        finally:
            rows.unpersist()
    return [out[i] for i in range(len(nets))]
