"""The classifiers: a grid of parameter sets of a model is fitted with few fits, and scores a row for all its points at once.

* Forests: the first n trees of a forest are a forest of n trees, and a tree grown deep and to small nodes holds every
  shallower one, and every one that splits larger nodes only. So one forest of the largest point serves the whole grid. The
  trees of all cells are grown together (``forests``); a single point, and cells too large for a task, are Spark ML's fits.
* Boosted trees: the first n rounds are those of n rounds, so there is one fit for each depth. Equal rows are one, with a weight.
* Bagged machines: all bags of all points and cells are fitted in joint passes (``bags``).
* Perceptrons: all networks of all points and cells are fitted in joint passes (``networks``), over equal rows as one with a weight.
* Others: a fit for each point.

Fits are Spark ML's (but for the bags, networks and grids of forests); fitted trees and weights are read back as arrays (``kernels``).
"""

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from memsight.operators import kernels
from memsight.operators.bags import fit_bags
from memsight.operators.forests import fit_forests
from memsight.operators.labels import parameter_space
from memsight.operators.networks import fit_networks
from memsight.session import shared_dir, stage, staged_path, tasks
from memsight.sources.stores import load_model, save_model

SEED = 42
MAX_DEPTH = 30   # the deepest trees Spark ML grows
THREADS = 8      # fits that share the cluster at a time, as long as their rows
FIT_BYTES = 1 << 30   # together have no more bytes than this: each fit caches its rows, and what does not fit goes to disk
ROWS = 50_000    # of a partition of a training matrix
PIECE = 8        # equal training rows that become one

# Hidden neurons of the perceptron by split and failure type.
NEURONS = {1: {1: 50, 2: 50, 3: 10}, 2: {1: 50, 2: 10, 3: 10}, 3: {1: 10, 2: 10, 3: 50}}

# The parameters tried per model.
GRIDS = {
    "RF": {"trees": [10, 50, 100], "depth": [5, 10, 50], "min_split": [5, 10, 50]},
    "GBDT": {"trees": [10, 50, 100], "depth": [5, 10], "leaves": [5, 10]},
    "LR": {"c": [0.01, 0.1]},
    "SVM": {"members": [10, 50, 100]},
    "MLP": {"layers": [1, 3, 5, 10, 20]},
}


def _depth(params):
    """Depth of a boosted tree: there is no limit on leaves, but a tree of this depth has about as many."""
    return min(params["depth"], math.ceil(math.log2(params["leaves"])))


def candidates(model: str, split=1, failure_type=1, grid=None) -> list:
    """The parameter sets to try: the fixed grid, or ``grid``."""
    space = parameter_space(GRIDS[model] if grid is None else grid)
    if model == "GBDT":  # depth and leaves both end up as a depth: each distinct fit once
        distinct = {(p["trees"], _depth(p)): p for p in reversed(space)}
        space = [p for p in space if distinct[p["trees"], _depth(p)] is p]
    if model == "MLP":
        space = [{"neurons": NEURONS[split][failure_type], **p} for p in space]
    return space


class Scorer:
    """A fitted grid of one model: ``points`` (parameter sets), ``kernel`` (scores rows for all of them), and what it is saved as:
    Spark ML models, or weights by point."""

    def __init__(self, model, points, kernel, fitted=(), weights=None):
        self.model, self.points, self.kernel, self.weights = model, points, kernel, weights
        self._fitted = fitted if callable(fitted) else list(fitted)

    @property
    def fitted(self):
        """The Spark ML models; those of a forest that was grown here are made when they are asked for."""
        if callable(self._fitted):
            self._fitted = list(self._fitted())
        return self._fitted

    @property
    def members(self):
        return self.weights[0]

    def point(self, i):
        """The scorer of one point."""
        if self.model == "RF":   # a point is cut out of the fitted trees again when it is loaded
            def fitted():
                return self.fitted
        elif self.model == "GBDT":
            fitted = [m for m in self.fitted if m.getMaxDepth() == _depth(self.points[i])]
        else:
            fitted = self.fitted[i:i + 1]
        return Scorer(self.model, [self.points[i]], kernels.pick(self.kernel, i), fitted, self.weights and [self.weights[i]])

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a vector ``features``) and ``pred``, the score of the first point."""
        kernel = kernels.pick(self.kernel, 0)

        @pandas_udf("double")
        def first(features: pd.Series) -> pd.Series:
            if features.empty:
                return pd.Series([], dtype="float64")
            return pd.Series(kernel.probabilities(np.stack(features.to_numpy()))[:, 0])

        kept = [c for c in rows.columns if c != "features"]
        return rows.select(*kept, first(vector_to_array("features")).alias("pred"))

    def save(self, spark, path):
        save_model(spark, path, self.model, self.points[0], self.fitted, self.weights and self.weights[0])


def load_scorer(spark, path):
    """A saved scorer of one point."""
    model, params, fitted, weights = load_model(spark, path)
    if weights is not None:
        return Scorer(model, [params], kernels.Linear([np.array(weights)]), weights=[np.array(weights)])
    return _scorer(spark, model, [params], fitted)


def _nodes(spark, fitted):
    """The nodes of fitted trees, as arrays with parents before children, and the trees' roots. They come from the saved form;
    there are at most two a training row and tree."""
    path = staged_path(spark, "model")
    fitted.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("limit"))
    table = node.toPandas().sort_values(["treeID", "id"], kind="stable")
    first = np.flatnonzero(np.diff(table["treeID"].to_numpy(), prepend=-1))   # ids count from 0 in each tree
    base = np.repeat(first, np.diff(first, append=len(table)))
    inner = table["leftChild"].to_numpy() >= 0
    feature = np.where(inner, table["feature"].to_numpy(), -1)
    left, right = (np.where(inner, table[c].to_numpy() + base, -1) for c in ("leftChild", "rightChild"))
    limit = np.where(inner, table["limit"].to_numpy(float), 0.0)
    return table, (feature, limit, left, right), table["rawCount"].to_numpy(), first


def _forest(spark, fitted, points):
    table, shape, rows, roots = _nodes(spark, fitted)
    stats = np.stack(table["impurityStats"].to_numpy())
    return _cut(shape, stats[:, 1] / stats.sum(1), rows, roots, points)


def _cut(shape, value, rows, roots, points):
    shapes = sorted({(min(p["depth"], MAX_DEPTH), p["min_split"]) for p in points})
    trees = kernels.Trees.cut((*shape, value, rows), roots, shapes)
    return kernels.Forest(trees, [(p["trees"], shapes.index((min(p["depth"], MAX_DEPTH), p["min_split"]))) for p in points])


TEMPLATES, MAKING = {}, Lock()   # session, trees, features -> a saved forest of leaves


def _spark_forest(spark, nodes, trees, width):
    """Spark ML's model of trees that were grown here: its saved form with these nodes, loaded. ``nodes``: as ``fit_forests`` gives them."""
    key = spark.sparkContext.applicationId, trees, width
    with MAKING:
        if key not in TEMPLATES:
            rows = spark.createDataFrame([(float(i), Vectors.sparse(width, [], [])) for i in range(2)], ["class", "features"])
            path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
            RandomForestClassifier(labelCol="class", featuresCol="features", numTrees=trees, maxDepth=1, seed=SEED).fit(rows).write().save(path)
            TEMPLATES[key] = path, spark.read.parquet(f"{path}/data").schema
    template, schema = TEMPLATES[key]
    feature, limit, left, right, negative, positive, roots = nodes
    sizes = np.diff(roots, append=len(feature))
    base, total = np.repeat(roots, sizes), negative + positive
    inner = feature >= 0
    a, b = np.where(inner, left, 0), np.where(inner, right, 0)
    impurity = 1 - (negative / total) ** 2 - (positive / total) ** 2
    gain = np.where(inner, impurity - (total[a] * impurity[a] + total[b] * impurity[b]) / total, -1.0)
    lists = pa.ListArray.from_arrays(np.cumsum([0, *inner], dtype=np.int32), pa.array(limit[inner]))
    split = pa.StructArray.from_arrays(
        [pa.array(feature.astype(np.int32)), lists, pa.array(np.full(len(feature), -1, np.int32))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = np.column_stack([negative, positive]).astype(float)
    own = {"id": (np.arange(len(feature)) - base).astype(np.int32), "prediction": (positive > negative).astype(float), "impurity": impurity,
           "impurityStats": pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * 2, stats.ravel()), "rawCount": total, "gain": gain,
           "leftChild": np.where(inner, left - base, -1).astype(np.int32), "rightChild": np.where(inner, right - base, -1).astype(np.int32), "split": split}
    data = pa.StructArray.from_arrays([pa.array(v) for v in own.values()], list(own))
    tree = pa.array(np.repeat(np.arange(trees, dtype=np.int32), sizes))
    path = staged_path(spark, "model")
    spark.createDataFrame(pa.table({"treeID": tree, "nodeData": data}), schema).write.parquet(f"{path}/data")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("metadata", "treesMetadata"):
        old, new = hadoop.Path(f"{template}/{part}"), hadoop.Path(f"{path}/{part}")
        hadoop.FileUtil.copy(old.getFileSystem(conf), old, new.getFileSystem(conf), new, False, conf)
    return RandomForestClassificationModel.load(path)


def _forests(points, train, by):
    """cell -> scorer of a forest that was grown here, for the cells that are not too large for it."""
    cells, spark = list(points), train.sparkSession
    kinds = ", ".join(f"{b} {train.schema[b].dataType.simpleString()}" for b in by)
    if by:
        numbers = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], f"{kinds}, cell int")
        rows = train.join(F.broadcast(numbers), by)
    else:
        rows = train.withColumn("cell", F.lit(0))
    trees = {i: max(p["trees"] for p in points[c]) for i, c in enumerate(cells)}
    depth = {i: min(max(p["depth"] for p in points[c]), MAX_DEPTH) for i, c in enumerate(cells)}
    least = {i: min(p["min_split"] for p in points[c]) for i, c in enumerate(cells)}
    grown = fit_forests(rows, trees, depth, least)
    width = rows.agg(F.max(F.size("values"))).first()[0] if grown else 0
    out = {}
    for i, nodes in grown.items():
        feature, limit, left, right, negative, positive, roots = nodes
        total = negative + positive
        kernel = _cut((feature, limit, left, right), positive / total, total, roots, points[cells[i]])
        out[cells[i]] = Scorer("RF", points[cells[i]], kernel, lambda nodes=nodes, n=trees[i]: [_spark_forest(spark, nodes, n, width)])
    return out


def _boosted(spark, fits, points):
    depths = [f.getMaxDepth() for f in fits]
    series = []
    for f in fits:
        table, shape, rows, roots = _nodes(spark, f)
        series.append((kernels.Trees.cut((*shape, table["prediction"].to_numpy(), rows), roots, [(None, None)]), np.array(f.treeWeights)))
    return kernels.Boosted(series, [(p["trees"], depths.index(_depth(p))) for p in points])


def _network(fitted):
    sizes, flat, at, layers = fitted.getLayers(), fitted.weights.toArray(), 0, []
    for a, b in zip(sizes, sizes[1:]):
        layers.append((flat[at:at + a * b].reshape(a, b).T, flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return layers


def _scorer(spark, model, points, fitted):
    """A scorer from Spark ML models: those of ``_fits``, in its order."""
    if model == "RF":
        return Scorer(model, points, _forest(spark, fitted[0], points), fitted)
    if model == "GBDT":
        return Scorer(model, points, _boosted(spark, fitted, points), fitted)
    if model == "LR":
        return Scorer(model, points, kernels.Linear([np.r_[f.coefficients.toArray(), f.intercept] for f in fitted]), fitted)
    return Scorer(model, points, kernels.Networks([_network(f) for f in fitted]), fitted)


def _fits(model, points, rows, width):
    """The estimators that serve all ``points``."""
    common = {"labelCol": "class", "featuresCol": "features"}
    if model == "RF":
        # the node that a row has reached in each tree is kept, 4 bytes each, and not searched from the root at every level
        return [RandomForestClassifier(
            cacheNodeIds=True, numTrees=max(p["trees"] for p in points), maxDepth=min(max(p["depth"] for p in points), MAX_DEPTH), seed=SEED, **common)]
    if model == "GBDT":
        return [GBTClassifier(weightCol="weight", maxIter=max(p["trees"] for p in points if _depth(p) == depth), maxDepth=depth, stepSize=0.1,
                              seed=SEED, **common)
                for depth in sorted({_depth(p) for p in points})]
    if model == "LR":
        return [LogisticRegression(regParam=1 / (p["c"] * max(rows, 1)), elasticNetParam=0.0, standardization=False, **common) for p in points]
    if model == "MLP":
        return [MultilayerPerceptronClassifier(layers=[width] + [p["neurons"]] * p["layers"] + [2], seed=SEED, **common) for p in points]
    raise ValueError(f"unknown model {model}; one of {', '.join(GRIDS)}")


def threads(sizes) -> int:
    """How many fits run at a time, for the bytes of their rows; large ones run one by one, and fill the cluster by themselves."""
    return max(1, min(THREADS, FIT_BYTES // max(1, *sizes)))


def combined(train: DataFrame, by=()) -> DataFrame:
    """``by``, class, values, weight of ``train``, staged: equal rows are one, whose weight is their number, and a fit that
    takes weights has less to do. More than ``PIECE`` equal rows are several: trees take their limits from a sample of the rows,
    which should not hang on a few heavy ones. Weights are whole, so their sums are exact. Groups are dealt by counted rows."""
    kept = [*by, "class", "values"]
    groups = train.repartition(tasks(train), *kept).groupBy(*kept).agg(F.count("*").alias("n"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE)), lambda at: F.least(F.lit(PIECE), F.col("n") - at).cast("double"))
    return stage(groups.select(*kept, F.explode(pieces).alias("weight")), by)


def _dealt(rows: DataFrame, n, keys=("sid", "t_predict")) -> DataFrame:
    """``rows``, ``n`` of a stored table, in partitions of about ``ROWS``: a fit holds each as one block. A table whose rows compress
    well is read in few partitions, whatever its rows, so that merging them cannot give enough; then they are shuffled."""
    parts = max(1, n // ROWS)
    return rows.coalesce(parts) if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, *keys)


def _perceptron(spark, layers, weights=None):
    """Spark ML's perceptron with these weights, else with the ones its fits start from: a fit of no iterations, which reads no values."""
    rows = spark.createDataFrame([(float(i), Vectors.sparse(layers[0], [], [])) for i in range(2)], ["class", "features"])
    start = None if weights is None else Vectors.dense(weights)
    return MultilayerPerceptronClassifier(
        labelCol="class", featuresCol="features", layers=layers, seed=SEED, maxIter=0, initialWeights=start).fit(rows)


def _networks(points, train, by):
    """cell -> Spark ML perceptrons of its ``points``."""
    cells, spark = list(points), train.sparkSession
    rows = combined(train, by)
    if by:
        kinds = ", ".join(f"{b} {train.schema[b].dataType.simpleString()}" for b in by)
        numbers = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], f"{kinds}, cell int")
        rows = rows.join(F.broadcast(numbers), by)
    else:
        rows = rows.withColumn("cell", F.lit(0))
    width = rows.agg(F.max(F.size("values"))).first()[0]
    nets = [(i, [width] + [p["neurons"]] * p["layers"] + [2]) for i, c in enumerate(cells) for p in points[c]]
    with ThreadPoolExecutor(THREADS) as pool:
        shapes = sorted({tuple(layers) for _, layers in nets})
        starts = dict(zip(shapes, pool.map(lambda s: _perceptron(spark, list(s)).weights.toArray(), shapes)))
        fitted = fit_networks(rows, nets, [starts[tuple(layers)] for _, layers in nets])
        made = iter(list(pool.map(lambda net: _perceptron(spark, net[0][1], net[1]), zip(nets, fitted))))
    return {c: [next(made) for _ in points[c]] for c in cells}


def fit_cells(model: str, points: dict, train: DataFrame, by=()) -> dict:
    """cell -> scorer of its parameter sets ``points[cell]``, for each cell in ``points``: values of the columns ``by`` of
    ``train`` (``by``, sid, t_predict, class, values). Training rows are under-sampled ones; hand in a staged table, as fits read it many times. Fits
    run from a pool of driver threads, on as many partitions as the rows need."""
    cells, by = list(points), list(by)
    if not cells:
        return {}
    if model == "SVM":
        members = sorted({p["members"] for own in points.values() for p in own})
        chosen = train.join(F.broadcast(train.sparkSession.createDataFrame(cells, by)), by) if by else train
        found = fit_bags(chosen, members, by)
        weights = {c: [found[c][p["members"]] for p in points[c]] for c in cells}
        return {c: Scorer(model, points[c], kernels.Linear(weights[c]), weights=weights[c]) for c in cells}
    # a single one of few rows is Spark ML's own fit: no pass is shared. Of many rows that keeps two uncompressed copies on disk
    if model == "MLP" and (sum(len(own) for own in points.values()) > 1 or train.count() > ROWS):
        found = _networks(points, train, by)
        return {c: Scorer("MLP", points[c], kernels.Networks([_network(f) for f in found[c]]), found[c]) for c in cells}
    made = {}
    if model == "RF" and all(max(p["trees"] for p in own) > 1 for own in points.values()) and sum(len(own) for own in points.values()) > 1:
        made = _forests(points, train, by)   # a single point is Spark ML's own fit
        cells = [c for c in cells if c not in made]
        if not cells:
            return made
    keys = ["sid", "t_predict"]
    if model == "GBDT":
        train, keys = combined(train, by), ["class", "values", "weight"]
    facts = train.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("values")).alias("width")).collect()
    facts = {tuple(r[c] for c in by): r for r in facts}

    def one(job):
        cell, estimator = job
        rows = train
        for c, v in zip(by, cell):
            rows = rows.filter(F.col(c) == v)
        rows = _dealt(rows.drop(*by), facts[cell].n, keys)
        return estimator.fit(rows.withColumn("features", array_to_vector("values")).drop("values"))

    estimators = {c: _fits(model, points[c], facts[c].n, facts[c].width) for c in cells}
    jobs = [(c, e) for c in cells for e in estimators[c]]
    # the longest first: those that start last then do not run on alone
    order = sorted(range(len(jobs)), key=lambda i: facts[jobs[i][0]].n, reverse=True)
    with ThreadPoolExecutor(threads([facts[c].n * facts[c].width * 8 for c in cells])) as pool:
        ended = dict(zip(order, pool.map(one, [jobs[i] for i in order])))
    fitted = iter([ended[i] for i in range(len(jobs))])
    parts = [(c, [next(fitted) for _ in estimators[c]]) for c in cells]
    with ThreadPoolExecutor(THREADS) as pool:
        return {**made, **dict(zip(cells, pool.map(lambda part: _scorer(train.sparkSession, model, points[part[0]], part[1]), parts)))}


def fit(model: str, params: dict, train: DataFrame) -> Scorer:
    """A scorer for RF, GBDT, LR, SVM or MLP of one parameter set; ``train``: sid, t_predict, class, and a vector ``features``."""
    if model not in GRIDS:
        raise ValueError(f"unknown model {model}; one of {', '.join(GRIDS)}")
    rows = train.select("sid", "t_predict", "class", vector_to_array("features").alias("values"))
    return fit_cells(model, {(): [params]}, rows)[()]
