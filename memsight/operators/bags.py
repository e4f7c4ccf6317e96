"""Bagged linear support vector machines, all bags of all cells fitted at once.

A machine is a bag of one cell. Its weights minimise the mean squared hinge loss of the bag's rows plus a penalty, by
limited-memory BFGS. A bag has a part of the rows, so that a task holds those of a machine, packed, and fits it by itself: all
machines are one job. Where a bag has more than ``BYTES`` of rows, one pass over all rows evaluates every machine at its own
trial point; the driver holds the machines' weights and the last few steps, and moves each machine on or shortens its step. The
number of jobs is then that of the passes, whatever the number of bags, and a pass hands on one row of sums for each machine and task.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memsight.session import stage

SEED = 42
PENALTY = 1.0      # over the rows of the bag
PASSES, MEMORY, TOLERANCE = 60, 6, 1e-4
BYTES = 256 << 20   # of a bag's rows, which a task holds
TASKS = 4           # a core


def _packed(batches):
    """``values`` as the bytes of their doubles: a pass copies a row's at once, while those of an array go one by one."""
    for batch in batches:
        n = batch.num_rows
        if n:
            values = np.ascontiguousarray(batch.column("values").flatten().to_numpy(zero_copy_only=False))
            ends = np.arange(n + 1, dtype=np.int32) * (values.nbytes // n)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield batch.set_column(batch.schema.get_field_index("values"), "values", packed)


def _unpacked(column):
    """The matrix of a batch's packed ``values``."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float64).reshape(len(column), -1)


def draw(train: DataFrame, members) -> DataFrame:
    """``train`` (cell, sid, t_predict, class, values) as cell, positive, values (packed) and ``bags``: the numbers of the bags that
    a row is in, bag i of n as n's offset + i, for each n in ``members``. Rows in no bag are left out.

    A bag of n takes 1/n of the rows by a hash of their key, so a retried or repeated job draws the same. Of a class none
    of whose rows a bag has drawn, it takes the row of the smallest hash: all bags hold both classes, if the cell does."""
    def of(n, offset):
        own = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.xxhash64("sid", "t_predict", F.lit(SEED) + i), F.lit(n)) == 0)
        return F.transform(own, lambda i: i + F.lit(offset))

    drawn = [of(n, offset) for n, offset in zip(members, np.cumsum([0, *members]).tolist())]
    # a folder a cell: a batch of rows then has the machines of one cell, with many rows each
    sid = train.schema["sid"].dataType.simpleString()
    dealt = stage(train.select("cell", "sid", "t_predict", (F.col("class") == 1).alias("positive"), "values", F.concat(*drawn).alias("bags"))
                  .mapInArrow(_packed, f"cell int, sid {sid}, t_predict long, positive boolean, values binary, bags array<int>"), ["cell"])
    found = dealt.select("cell", "positive", F.explode("bags").alias("bag")).distinct()
    wanted = dealt.select("cell", "positive").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(sum(members) - 1))).alias("bag"))
    # a class that some bag has missed is small: none of k rows is in a bag of n with probability exp(-k / n)
    missing = wanted.join(found, ["cell", "positive", "bag"], "left_anti").groupBy("cell", "positive").agg(F.collect_list("bag").alias("missing"))
    own = dealt.join(F.broadcast(missing), ["cell", "positive"]).select(
        "cell", "positive", "sid", "t_predict", "values", F.explode("missing").alias("bag"))
    number = F.element_at(F.lit([i for n in members for i in range(n)]), F.col("bag") + 1)   # of the bag among its n
    least = own.groupBy("cell", "positive", "bag").agg(
        F.min_by("values", F.struct(F.xxhash64("sid", "t_predict", F.lit(SEED) + number), "sid", "t_predict")).alias("values"))
    return dealt.filter(F.size("bags") > 0).select("cell", "positive", "values", "bags").unionByName(
        stage(least.select("cell", "positive", "values", F.array("bag").alias("bags"))))


def _evaluate(weights, scale, bags):
    """Rows of a task -> for each machine that has some: their number, loss and gradient sums. ``scale``: deviations of the
    features, a row a cell; a cell has ``bags`` machines. The rows of a machine in a batch are taken together, as products of
    matrices: a sum for each row and machine of its own takes several times as long."""
    spread = np.repeat(scale, bags, axis=0)
    slopes, offsets = weights[:, :-1] / spread, weights[:, -1]   # of the features as they are

    def run(batches):
        sums = np.zeros((len(weights), weights.shape[1] + 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cell = batch.column("cell").to_numpy().astype(np.int64)
            x = _unpacked(batch.column("values"))
            y = np.where(batch.column("positive").to_numpy(zero_copy_only=False), 1.0, -1.0)
            held = batch.column("bags")
            row = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
            machine = held.flatten().to_numpy() + cell[row] * bags
            order = np.argsort(machine, kind="stable")
            row, machine = row[order], machine[order]
            starts = np.flatnonzero(np.diff(machine, prepend=-1))
            for at, end in zip(starts, np.append(starts[1:], len(machine))):
                m, own = machine[at], row[at:end]
                rows, side = x[own], y[own]
                gap = np.maximum(1 - side * (rows @ slopes[m] + offsets[m]), 0)
                pull = -2 * gap * side
                sums[m, 0] += end - at
                sums[m, 1] += gap @ gap
                sums[m, 2:-1] += pull @ rows
                sums[m, -1] += pull.sum()
        sums[:, 2:-1] /= spread
        some = np.flatnonzero(sums[:, 0])
        if len(some):
            lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * sums.shape[1], sums[some].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], ["machine", "sums"])
    return run


def _pass(rows, weights, scale):
    """(rows, mean loss, gradient) of every machine at ``weights``, by one job."""
    width = weights.shape[1] + 2
    parts = rows.mapInArrow(_evaluate(weights, scale, len(weights) // len(scale)), "machine int, sums array<double>")
    total = parts.groupBy("machine").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out = np.zeros((len(weights), width))
    for r in total.collect():   # a row a machine
        out[r.machine] = r.sums
    n = np.maximum(out[:, 0], 1)
    return out[:, 0], out[:, 1] / n, out[:, 2:] / n[:, None]


def _direction(gradient, steps, changes):
    """Minus the inverse curvature times the gradient, by the two-loop recursion for all machines at once."""
    q, kept = -gradient, []
    for s, y in zip(reversed(steps), reversed(changes)):
        rho = (s * y).sum(1)
        rho = np.where(rho > 1e-12, 1 / np.maximum(rho, 1e-12), 0)   # 0: the pair of a machine that has none
        a = rho * (s * q).sum(1)
        q = q - a[:, None] * y
        kept.append((rho, a, s, y))
    if steps:
        s, y = steps[-1], changes[-1]
        sy, yy = (s * y).sum(1), (y * y).sum(1)
        q = q * np.where(sy > 1e-12, sy / np.maximum(yy, 1e-300), 1)[:, None]
    for rho, a, s, y in reversed(kept):
        q = q + (a - rho * (y * q).sum(1))[:, None] * s
    return q


def _descend(evaluate, count, width, passes):
    """Weights of ``count`` machines; ``evaluate``: their weights -> (rows, mean loss, gradient) of each."""
    w = np.zeros((count, width + 1))
    size, loss, gradient = evaluate(w)
    mask = np.r_[np.ones(width), 0]           # the intercept is not punished
    weight = (PENALTY / np.maximum(size, 1))[:, None] * mask

    def whole(at, loss, gradient):
        return loss + (weight * at * at).sum(1) / 2, gradient + weight * at

    f, g = whole(w, loss, gradient)
    if not (np.isfinite(f).all() and np.isfinite(g).all()):
        raise ArithmeticError("a feature of the bags' rows is not finite")
    steps, changes = [], []
    d = -g / np.maximum(1, np.linalg.norm(g, axis=1))[:, None]
    t = np.ones(count)
    open_ = np.ones(count, bool)
    for _ in range(passes):
        trial = np.where(open_[:, None], w + t[:, None] * d, w)
        _, loss, gradient = evaluate(trial)
        f2, g2 = whole(trial, loss, gradient)
        good = open_ & (f2 <= f + 1e-4 * t * (g * d).sum(1))
        t = np.where(good, 1.0, t / 2)
        steps, changes = [*steps, np.where(good[:, None], trial - w, 0)][-MEMORY:], [*changes, np.where(good[:, None], g2 - g, 0)][-MEMORY:]
        small = good & (np.linalg.norm(g2, axis=1) <= TOLERANCE * np.maximum(1, np.linalg.norm(trial, axis=1)))
        w, f, g = np.where(good[:, None], trial, w), np.where(good, f2, f), np.where(good[:, None], g2, g)
        open_ &= ~small & (t > 1e-10)
        if not open_.any():
            break
        fresh = _direction(g, steps, changes)
        down = (fresh * g).sum(1) < 0
        d = np.where(good[:, None], np.where(down[:, None], fresh, -g), d)
    return w


def _gathered(bags):
    """Rows of a task -> machine, at, rows, data: a machine's rows in a batch, packed column by column, and their order."""
    def run(batches):
        part, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _unpacked(batch.column("values"))
            positive = batch.column("positive").to_numpy(zero_copy_only=False)
            held = batch.column("bags")
            row = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
            machine = held.flatten().to_numpy() + batch.column("cell").to_numpy().astype(np.int64)[row] * bags
            order = np.argsort(machine, kind="stable")
            row, machine = row[order], machine[order]
            starts = np.flatnonzero(np.diff(machine, prepend=-1))
            ends = np.append(starts[1:], len(machine))
            if not len(starts):
                continue
            data = []
            for a, b in zip(starts, ends):
                own = row[a:b]
                data.append(pa.compress(x[own].tobytes(order="F") + positive[own].tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(machine[starts].astype(np.int32)), pa.array(part + at + np.arange(len(starts))), pa.array((ends - starts).astype(np.int32)),
                 pa.array(data, pa.binary())], ["machine", "at", "rows", "data"])
            at += len(starts)
    return run


def _fitted(scale, bags, passes):
    """Packed rows, ordered by machine -> the weights of each machine."""
    width = scale.shape[1]

    def one(machine, blocks):
        n, at = sum(rows for rows, _ in blocks), 0
        x, side = np.empty((n, width)), np.empty(n)
        for rows, data in blocks:
            raw = pa.decompress(data, rows * (8 * width + 1), "zstd", asbytes=True)
            x[at:at + rows] = np.frombuffer(raw, np.float64, rows * width).reshape(width, rows).T
            side[at:at + rows] = np.where(np.frombuffer(raw, np.bool_, rows, 8 * rows * width), 1.0, -1.0)
            at += rows
        spread = scale[machine // bags]

        def evaluate(w):
            gap = np.maximum(1 - side * (x @ (w[0, :-1] / spread) + w[0, -1]), 0)
            pull = -2 * gap * side
            return np.array([float(n)]), np.array([gap @ gap]) / n, np.r_[(pull @ x) / spread, pull.sum()][None, :] / n
        try:
            return _descend(evaluate, 1, width, passes)[0]
        except ArithmeticError:   # the driver raises it again, of any machine
            return np.full(width + 1, np.nan)

    def run(batches):
        def made(machine, blocks):
            return pa.RecordBatch.from_arrays([pa.array([machine], pa.int32()), pa.array([one(machine, blocks)], pa.list_(pa.float64()))], ["machine", "w"])
        now, held = None, []
        for batch in batches:
            for machine, rows, data in zip(batch.column("machine").to_pylist(), batch.column("rows").to_pylist(), batch.column("data").to_pylist()):
                if held and machine != now:
                    yield made(now, held)
                    held = []
                now = machine
                held.append((rows, data))
        if held:
            yield made(now, held)
    return run


def _alone(rows, scale, members, passes):
    """Weights of all machines, each fitted by the task that has its rows. Machines are dealt by their rows, the largest first."""
    bags, spark = sum(members), rows.sparkSession
    blocks = stage(rows.mapInArrow(_gathered(bags), "machine int, at long, rows int, data binary"))
    sizes = sorted(((r.n, r.machine) for r in blocks.groupBy("machine").agg(F.sum("rows").alias("n")).collect()), reverse=True)   # a row a machine
    tasks = min(len(sizes), TASKS * spark.sparkContext.defaultParallelism)
    load, numbers = [(0, i) for i in range(tasks)], []
    for n, machine in sizes:
        least, task = heapq.heappop(load)
        numbers.append((machine, task))
        heapq.heappush(load, (least + n, task))
    dealt = blocks.join(F.broadcast(spark.createDataFrame(numbers, "machine int, task int")), "machine").repartitionById(tasks, F.col("task"))
    found = dealt.sortWithinPartitions("machine", "at").select("machine", "rows", "data").mapInArrow(_fitted(scale, bags, passes), "machine int, w array<double>")
    out = np.full((len(scale) * bags, scale.shape[1] + 1), np.nan)
    for r in found.collect():   # a row a machine
        out[r.machine] = r.w
    return out


def fit_bags(train: DataFrame, members, by=(), passes=PASSES) -> dict:
    """cell -> {n: weights (n x features + 1, the intercept last)} for each n in ``members``, of ``train`` (``by``, sid, t_predict,
    class, values). A cell of one class only raises; so do weights that are not finite."""
    members, by = list(members), list(by)
    spread = train.select(*by, "class", "values").groupBy(*by).agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.size("values")).alias("width")).collect()
    if not spread or any(r.low == r.high for r in spread):
        raise ValueError("bags need rows of both classes")
    width, cells = spread[0].width, sorted(tuple(r[c] for c in by) for r in spread)
    if by:
        train = train.join(F.broadcast(train.sparkSession.createDataFrame(
            [(*c, i) for i, c in enumerate(cells)], [*by, "cell"])), by)
    else:
        train = train.withColumn("cell", F.lit(0))
    rows = draw(train.withColumn("cell", F.col("cell").cast("int")), members)
    deviations = train.groupBy("cell").agg(F.array(*[F.stddev_pop(F.col("values")[j]) for j in range(width)]).alias("s")).collect()
    scale = np.ones((len(cells), width))
    for r in deviations:
        scale[r.cell] = [s if s and math.isfinite(s) else 1.0 for s in r.s]

    bags = sum(members)
    largest = train.groupBy("cell").count().agg(F.max("count")).first()[0] / min(members)
    if largest * width * 8 <= BYTES:
        w = _alone(rows, scale, members, passes)
    else:
        w = _descend(lambda at: _pass(rows, at, scale), len(cells) * bags, width, passes)
    if not np.isfinite(w).all():
        raise ArithmeticError("weights of a machine are not finite")
    out = {}
    for i, c in enumerate(cells):
        own = w[i * bags:(i + 1) * bags]
        parts = np.split(np.column_stack([own[:, :-1] / scale[i], own[:, -1:]]), np.cumsum(members)[:-1])
        out[c] = dict(zip(members, parts))
    return out
