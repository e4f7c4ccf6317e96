"""What the registered queries of the experiments cover."""

from itertools import product

from checks import learning
from memsight.plans import experiments


def covered(spark, monkeypatch, name):
    """(model, type, split, variant) of each cell that a query runs, and the grids it is given."""
    seen, grids = set(), []

    def run(data, experiment, model, freq, cells, variant, group=4, grid=None, known=False, with_lead=False):
        seen.update((model, *cell, variant, freq, data.horizon) for cell in cells)
        grids.append(grid)
        return experiments._rows(cells, {}, variant)

    monkeypatch.setattr(experiments, "_run", run)
    monkeypatch.setattr(learning, "_data", lambda *_: experiments.Data({}, spark.range(1)))
    learning.QUERIES[name](spark, None).collect()
    return seen, grids


def test_experiments_run_over_all_types_splits_variants_and_grids(spark, monkeypatch):
    every, day = list(product((1, 2, 3), (1, 2, 3))), 86400
    for name, variants, freq in (("x1_feature_groups", (1, 2, 3, 4), "5m"), ("x3_intervals", ("30m", "1h", "5d"), None),
                                 ("x4_lead_times", ("5m",), "5m"), ("x4_averages", ("5m",), "5m")):
        seen, grids = covered(spark, monkeypatch, name)
        assert seen == {("RF", t, s, v, freq or v, day) for t, s in every for v in variants} and set(grids) == {None}, name
    assert covered(spark, monkeypatch, "x2_models")[0] == {(m, t, s, m, "5m", day) for m in ("GBDT", "LR", "SVM", "MLP") for t, s in every}


def test_each_model_runs_over_its_whole_grid(spark, monkeypatch):
    for name, model in (("random_forest", "RF"), ("gradient_boosting", "GBDT"), ("logistic_regression", "LR"), ("bagged_svm", "SVM"),
                        ("perceptron", "MLP")):
        seen, grids = covered(spark, monkeypatch, f"x2_grid_{name}")
        assert seen == {(model, t, s, model, "5m", 86400) for t, s in product((1, 2, 3), (1, 2, 3))} and set(grids) == {None}


def test_whole_models_take_every_row_and_feature(spark, monkeypatch):
    """Rows of 3 to 11 errors are scored too, and the learner finds the class among 52 features."""
    from pyspark.sql import functions as F

    from memsight.operators.features import feature_columns

    names = feature_columns(4)
    rows = spark.range(400).select(
        F.col("id").alias("sid"), F.lit("0001-05-01 00:00:00").alias("predict_time"), F.col("id").alias("t_predict"),
        *[(F.col("id") % 20 if c == "5min_counter" else F.xxhash64("id", F.lit(c)) % 5).cast("double").alias(c) for c in names])
    monkeypatch.setattr(learning, "table", lambda *_: rows)
    learning._whole.cache_clear()
    whole = learning._whole(spark, "a")
    assert whole.count() == 400 and len(whole.first()["features"]) == len(names) == 52
    got = learning.QUERIES["a1_random_forest_whole"](spark, "a").collect()
    assert len(got) == 400 and sum(r["class"] for r in got) == 160 and all(r.scored for r in got)
    assert sum(r.held_out for r in got) == 134 and all(r.learned for r in got)
    for value in (0.1, 0.9):   # a constant predictor turns the rows of a class red
        constant = learning._learned(whole.drop("features").withColumn("pred", F.lit(value))).collect()
        assert {r["class"]: r.learned for r in constant} == {0: value < .5, 1: value > .5}
    learning._whole.cache_clear()
