"""Registered queries of the stores, models and experiments. Models learn a class that SQL computes too; experiments have no
SQL form."""

import uuid
from functools import lru_cache, reduce
from operator import and_

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from checks import fixture
from checks.features import rounded
from checks.fixture import ROLLING_ERRORS
from checks.features import COUNTER, HARD, _windows
from checks.fixture import MIN_ERRORS
from checks.measurement import PARTS
from checks.sqltext import query, text
from memsight.operators import evaluate, labels, models, spatial
from memsight.plans import experiments
from memsight.plans.features import feature_table
from memsight.session import shared_dir, stage, stage_made
from memsight.sources import stores

FREQ, TYPE, SPLIT = "5d", 1, 1
EXPERIMENT = "5m"
FREQS = ("30m", "1h", "5d")
# one point of the published grid for each model
SMALL = {"trees": [10], "depth": [5], "min_split": [10]}
SMALL_GRIDS = {"GBDT": {"trees": [10], "depth": [5], "leaves": [5]}, "LR": {"c": [0.1]}, "SVM": {"members": [10]},
               "MLP": {"layers": [1]}}


@lru_cache(maxsize=8)
def table(spark, d, freq=FREQ):
    log, _, inventory = fixture.inputs(spark, d)
    return stage_made(spark, lambda: feature_table(log, inventory, freq, range(1, 9), ROLLING_ERRORS))


def _data(spark, d, *freqs):
    """Inputs of an experiment. Nothing that an earlier query fitted is taken."""
    positives = stage(evaluate.known_positives(*fixture.inputs(spark, d), labels.SPLITS))
    tables = {freq: table(spark, d, freq) for freq in freqs or (EXPERIMENT,)}
    return experiments.Data(tables, fixture.tickets(spark, d), positives, _folder(spark, "models"))


def _grid(model):
    """All points of the published grid of one model, for each type and split; the best of a cell is its row."""
    return lambda spark, d: experiments.by_model(_data(spark, d), names=[model])


def _replay(spark, d, splits=(SPLIT,)):
    """The saved models of experiment 4 against the run that saved them."""
    data = _data(spark, d)
    ran = experiments.by_lead_time(data, splits=splits, grid=SMALL)
    names = ["failure_type", "split", "f1", "precision", "recall", "fpr", "n_useless", "n_useful"]
    again = experiments.replays(data, 4, [EXPERIMENT], splits=splits).select(*names[:2], *[F.col(n).alias(f"again_{n}") for n in names[2:]])
    same = [F.abs(F.col(n) - F.col(f"again_{n}")) < 1e-9 for n in names[2:]]
    return ran.join(again, names[:2]).select(*names[:2], reduce(and_, same).alias("agree"))


def _folder(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


LOW, HIGH = 2, 12   # errors of a window: class 1 from HIGH on; what a linear model predicts is certain up to LOW and from HIGH on


@lru_cache(maxsize=4)
def _constructed(spark, d):
    """All rows of the feature table, with a class that follows from the error counter, which is cut at ``HIGH``."""
    made = VectorAssembler(inputCols=["counter"], outputCol="features").transform(table(spark, d).select(
        "sid", "predict_time", "t_predict", (F.col("5min_counter") >= HIGH).cast("double").alias("class"),
        F.least(F.col("5min_counter"), F.lit(HIGH)).alias("counter")))
    return stage(made)


def _point(name, point):
    found, = [p for p in models.candidates(name, SPLIT, TYPE) if all(p[k] == v for k, v in point.items())]
    return found


def _model(name, **point):
    """All rows of the constructed class, as predicted by a model of one point of the published grid; -1 where SQL cannot tell."""
    def run(spark, d):
        rows = _constructed(spark, d)
        scored = models.fit(name, _point(name, point), rows).score(rows)
        certain = (F.col("counter") <= LOW) | (F.col("counter") >= HIGH)
        return scored.select("sid", "predict_time", F.col("class").cast("int").alias("class"),
                             F.when(certain, (F.col("pred") > 0.5).cast("int")).otherwise(-1).alias("predicted"))
    return run


@lru_cache(maxsize=4)
def _whole(spark, d):
    """All rows of the feature table with all features; class 1 from ``HIGH`` errors on. Servers whose id is divisible by 3 are held out."""
    rows = table(spark, d).withColumn("class", (F.col("5min_counter") >= HIGH).cast("double"))
    return stage(labels.matrix(rows, 4).withColumn("held_out", F.col("sid") % 3 == 0))


RIGHT = 0.7   # of the held-out rows of a class that a model predicts right; a constant predictor has none of one class


def _whole_model(name, **point):
    """A model of all 52 features, fitted on the servers that are not held out, scores every row. ``learned``: whether it predicts
    enough of the held-out rows of the row's class right."""
    def run(spark, d):
        rows = _whole(spark, d)
        return _learned(models.fit(name, _point(name, point), rows.filter("NOT held_out")).score(rows))
    return run


def _learned(scored):
    scored = scored.withColumn("hit", ((F.col("pred") > 0.5) == (F.col("class") == 1)).cast("int"))
    shares = scored.groupBy("class").agg((F.avg(F.when(F.col("held_out"), F.col("hit"))) >= RIGHT).alias("learned"))   # two rows
    return scored.join(F.broadcast(shares), "class").select(
        "sid", "predict_time", F.col("class").cast("int").alias("class"), "held_out", F.col("pred").between(0, 1).alias("scored"), "learned")


def _s4(spark, d):
    path = _folder(spark, "features")
    stores.write_features(table(spark, d), path)
    return rounded(stores.read_features(spark, path, FREQ, [6, 7]).select(
        "sid", "predict_time", "month", F.col("5min_counter").alias("counter"), F.col("5min_mtbe").alias("mtbe")))


def _s5(spark, d):
    path = _folder(spark, "report")
    report = spatial.component_breakdown(*fixture.inputs(spark, d), min_errors=MIN_ERRORS)
    stores.write_report(report, path, ["failure_type", "window", "component"])
    return stores.read_report(spark, path, report.schema)


def _s6(spark, d):
    path = stores.model_path(_folder(spark, "models"), 2, SPLIT, TYPE, "LR")
    rows = _constructed(spark, d)
    fitted = models.fit("RF", {"trees": 10, "depth": 5, "min_split": 5}, rows)
    fitted.save(spark, path)
    again = models.load_scorer(spark, path).score(rows).select("sid", "predict_time", F.col("pred").alias("again"))
    both = fitted.score(rows).join(again, ["sid", "predict_time"])
    return both.select("sid", "predict_time", (F.abs(F.col("pred") - F.col("again")) < 1e-12).alias("agree"))


QUERIES = {
    "s4_feature_store": _s4,
    "s5_report": _s5,
    "s6_saved_model": _s6,
    "a1_random_forest": _model("RF", trees=10, depth=5, min_split=5),
    "a2_gradient_boosting": _model("GBDT", trees=10, depth=5, leaves=5),
    "a3_logistic_regression": _model("LR", c=0.1),
    "a4_bagged_svm": _model("SVM", members=10),
    "a5_perceptron": _model("MLP", layers=1),
    "a1_random_forest_whole": _whole_model("RF", trees=10, depth=5, min_split=5),
    "a2_gradient_boosting_whole": _whole_model("GBDT", trees=10, depth=5, leaves=5),
    "a3_logistic_regression_whole": _whole_model("LR", c=0.1),
    "a4_bagged_svm_whole": _whole_model("SVM", members=10),
    "a5_perceptron_whole": _whole_model("MLP", layers=1),
    "x1_feature_groups": lambda s, d: experiments.by_feature_group(_data(s, d)),
    "x2_models": lambda s, d: experiments.by_model(_data(s, d), grids=SMALL_GRIDS),
    "x2_grid_random_forest": _grid("RF"),
    "x2_grid_gradient_boosting": _grid("GBDT"),
    "x2_grid_logistic_regression": _grid("LR"),
    "x2_grid_bagged_svm": _grid("SVM"),
    "x2_grid_perceptron": _grid("MLP"),
    "x3_intervals": lambda s, d: experiments.by_interval(_data(s, d, *FREQS), FREQS),
    "x4_lead_times": lambda s, d: experiments.by_lead_time(_data(s, d)),
    "x4_averages": lambda s, d: experiments.averages(experiments.by_lead_time(_data(s, d))),
    "x4_saved_models": _replay,
    "x4_saved_models_all_splits": lambda s, d: _replay(s, d, experiments.SPLIT_IDS),
}

CONSTRUCTED = f"""SELECT sid, {text('f.rb')} AS predict_time, CAST("5min_counter" >= {HIGH} AS int) AS class,
  CASE WHEN "5min_counter" <= {LOW} OR "5min_counter" >= {HIGH} THEN CAST("5min_counter" >= {HIGH} AS int) ELSE -1 END AS predicted FROM counter f"""
COUNTED = _windows(FREQ, range(1, 9)) + "," + HARD + "," + COUNTER
WHOLE = query(f"""SELECT sid, {text('f.rb')} AS predict_time, CAST("5min_counter" >= {HIGH} AS int) AS class, sid % 3 = 0 AS held_out,
  true AS scored, true AS learned FROM counter f""", COUNTED)
LEARNED = query(CONSTRUCTED, COUNTED)

ORACLE = {
    "x4_saved_models": f"""SELECT t.failure_type, {SPLIT} AS split, true AS agree
      FROM (VALUES (1), (2), (3)) t(failure_type)""",
    "x4_saved_models_all_splits": """SELECT t.failure_type, s.split, true AS agree
      FROM (VALUES (1), (2), (3)) t(failure_type), (VALUES (1), (2), (3)) s(split)""",
    "s6_saved_model": query(f"SELECT sid, predict_time, true AS agree FROM ({CONSTRUCTED})", COUNTED),
    **{name: LEARNED for name in ("a1_random_forest", "a2_gradient_boosting", "a3_logistic_regression", "a4_bagged_svm", "a5_perceptron")},
    **{f"{name}_whole": WHOLE for name in ("a1_random_forest", "a2_gradient_boosting", "a3_logistic_regression", "a4_bagged_svm", "a5_perceptron")},
    "s4_feature_store": query(
        f"""SELECT sid, {text('f.rb')} AS predict_time, month, "5min_counter" AS counter, "5min_mtbe" AS mtbe
        FROM counter f WHERE month IN (6, 7)""", _windows(FREQ, range(1, 9)) + "," + HARD + "," + COUNTER),
    "s5_report": query("SELECT * FROM parts", PARTS),
}
