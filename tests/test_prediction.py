import hashlib
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from memsight.operators import bags, evaluate, forests, kernels, labels, models, networks
from memsight.operators.features import feature_columns
from memsight.plans import experiments
from tests.helpers import make_inventory, make_log, make_tickets, off

FAIL = off(6, 10)


def windows_of(spark, rows):
    return spark.createDataFrame([(s, f"p{t}", t, 6) for s, t in rows], "sid long, predict_time string, t_predict long, month int")


def test_labels(spark):
    rows = windows_of(spark, [(1, FAIL - 90000), (1, FAIL - 86400), (1, FAIL), (1, FAIL + 1), (2, FAIL - 5), (3, FAIL), (4, FAIL - 5)])
    tickets = make_tickets(spark, [(1, FAIL, 1), (2, FAIL, 2), (4, FAIL, 0)])
    found = lambda df: sorted((r["sid"], r["t_predict"] - FAIL, r["class"]) for r in df.collect())
    own = [(1, -90000, 0), (1, -86400, 1), (1, 0, 1)]
    assert found(labels.train_labels(rows, tickets, 1)) == own + [(3, 0, 0), (4, -5, 0)]
    assert found(labels.test_labels(rows, tickets, 1)) == own + [(2, -5, 0), (3, 0, 0), (4, -5, 0)]


def test_splits(spark):
    rows = spark.range(1, 9).select(F.col("id").cast("int").alias("month"))
    found = {(r["split"], r["role"], r["month"]) for r in labels.with_splits(rows).collect()}
    assert found == {(s, "train", m) for s in (1, 2, 3) for m in range(s, s + 5)} | {(s, "test", s + 5) for s in (1, 2, 3)}


@pytest.mark.parametrize("positives,negatives,ratio", [(3, 1000, 0.02), (3, 100, 0.02), (0, 50, 0.02), (7, 5000, 0.01), (4, 10, 0)])
def test_under_sampling_takes_the_smallest_hashes(spark, positives, negatives, ratio):
    rows = [(i, "p", 1 if i < positives else 0) for i in range(positives + negatives)]
    df = spark.createDataFrame(rows, "sid long, predict_time string, class int")
    kept = {r["sid"] for r in labels.under_sample(df, ratio).collect() if r["class"] == 0}
    order = sorted(range(positives, positives + negatives), key=lambda i: hashlib.md5(f"42-{i}-p".encode()).hexdigest())
    wanted = negatives if ratio == 0 else int(positives / ratio)
    assert kept == set(order[:wanted])
    assert labels.under_sample(df, ratio).filter("class = 1").count() == positives


def test_parameter_space():
    assert labels.parameter_space({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert [len(models.candidates(m)) for m in ("RF", "GBDT", "LR", "SVM", "MLP")] == [27, 6, 2, 3, 5]
    assert models.candidates("MLP", 3, 3)[0]["neurons"] == 50


def scored(spark, rows):
    return spark.createDataFrame(rows, "sid long, t_predict long, class int, pred double")


def test_confusion(spark):
    rows = [(1, 1, 1, .9), (1, 2, 1, .1),       # hit
            (2, 1, 0, .9), (2, 2, 1, .5),       # outside the horizon only: false positive and false negative
            (3, 1, 0, .6), (4, 1, 0, .5)]       # equal to the threshold is not predicted
    assert tuple(evaluate.confusion(scored(spark, rows), .5).first()) == (1, 2, 1, 0)
    # the last row of a server says whether it is positive; fn may be negative
    assert tuple(evaluate.confusion(scored(spark, [(1, 1, 1, .9), (1, 2, 0, .1)]), .5).first()) == (1, 0, -1, 1)


def test_metrics(spark):
    cells = spark.createDataFrame([(8, 2, 2, 988, 20), (8, 20, 2, 970, 20), (0, 5, 2, 95, 20), (8, 0, 2, 990, 20), (0, 0, 1, 0, 20)],
                                  "tp long, fp long, fn long, tn long, known long")
    first, noisy, none, clean, empty = evaluate.with_metrics(cells).collect()
    assert (first["precision"], first["recall"]) == (.8, .8) and first["f1"] == pytest.approx(.8)
    assert (noisy["f1"], noisy["fpr"]) == (0, 0)
    assert (none["f1"], none["fpr"]) == (0, .05)
    assert clean["precision"] == 1 and empty["fpr"] is None
    first, noisy, none, clean, empty = evaluate.with_metrics(cells, "known").collect()
    assert (first["recall"], first["fn"]) == (.4, 12)
    assert (clean["f1"], none["fpr"]) == (0, .05)


def test_sweep_equals_single_thresholds(spark):
    pick = random.Random(3)
    df = scored(spark, [(pick.randrange(60), t, int(pick.random() < .2), pick.choice([round(pick.random(), 2), pick.random(), 0.0, 1.0]))
                        for t in range(400)]).cache()
    rows = {round(r["threshold"] * 100): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in evaluate.sweep(df).collect()}
    assert len(rows) == 100
    for i in (0, 1, 29, 50, 57, 99):
        assert rows[i] == tuple(evaluate.confusion(df, i / 100).first())
    for tp, fp, fn, tn in rows.values():
        assert tp + fp + fn + tn == df.select("sid").distinct().count()


def test_best_threshold(spark):
    rows = [(s, 1, 0, .1) for s in range(500)] + [(1000 + s, 1, 1, .5 if s else .8) for s in range(5)]
    best = evaluate.best_threshold(scored(spark, rows)).first()
    assert (best["f1"], best["threshold"], best["tp"], best["tn"]) == (1, .1, 5, 500)
    none = evaluate.best_threshold(scored(spark, rows[:500])).first()
    assert (none["f1"], none["threshold"], none["tp"]) == (0, 0, None)


def test_lead_time(spark):
    df = scored(spark, [(1, FAIL - 900, 1, .9), (1, FAIL - 100, 1, .9), (2, FAIL - 300, 1, .9), (3, FAIL - 900, 1, .2), (4, FAIL - 900, 0, .9)])
    tickets = make_tickets(spark, [(s, FAIL, 1) for s in (1, 2, 3, 4)])
    assert tuple(evaluate.lead_time(df, tickets, .5).first()) == (1, 1)


def test_known_positives(spark):
    log = make_log(spark, [(s, 3, 0, 0, 1, 1, 1, FAIL - gap) for s, gap in ((1, 301), (2, 300), (3, 9999))])
    inventory = make_inventory(spark, [(s, "A1", 8, "M1") for s in (1, 2, 3)])
    tickets = make_tickets(spark, [(1, FAIL, 1), (2, FAIL, 1), (3, off(5, 9), 1)])
    found = [tuple(r) for r in evaluate.known_positives(log, tickets, inventory, labels.SPLITS).collect()]
    assert len(found) == 9 and [r for r in found if r[2]] == [(1, 1, 1)]


@pytest.fixture(scope="module")
def separable(spark):
    pick = random.Random(1)
    rows = []
    for i in range(400):
        label = float(i % 8 == 0)
        rows.append((i, 1, 1, 1, label, Vectors.dense([pick.gauss(4 * label, .5), pick.gauss(-4 * label, .5)])))
    return spark.createDataFrame(rows, ["sid", "t_predict", "failure_type", "split", "class", "features"]).cache()


@pytest.mark.parametrize("name,params", [
    ("RF", {"trees": 10, "depth": 5, "min_split": 5}), ("GBDT", {"trees": 5, "depth": 5, "leaves": 5}), ("LR", {"c": 10}),
    ("SVM", {"members": 3}), ("MLP", {"layers": 1, "neurons": 5})])
def test_models_separate(spark, separable, name, params, tmp_path):
    scorer = models.fit(name, params, separable)
    out = scorer.score(separable)
    assert out.count() == separable.count() and out.filter("pred < 0 or pred > 1 or pred is null").count() == 0
    assert evaluate.best_threshold(out).first()["f1"] > .9
    scorer.save(spark, str(tmp_path / name))
    loaded = models.load_scorer(spark, str(tmp_path / name))
    assert type(loaded.kernel) is type(scorer.kernel) and loaded.points == [params]
    again = loaded.score(separable)
    both = out.join(again.select("sid", F.col("pred").alias("pred2")), "sid")
    assert both.filter("abs(pred - pred2) > 1e-9").count() == 0


def test_unknown_model(separable):
    with pytest.raises(ValueError):
        models.fit("DNN", {}, separable)


def test_experiment_four_and_replay(spark, tmp_path):
    """Failing servers log many errors: the forest must find them, and the saved model must agree."""
    rows, tickets = [], []
    for month in range(1, 7):
        for s in range(30):
            sid, fails = month * 100 + s, s < 4
            n = 40 if fails else 2
            rows += [(sid, f"p{k}", off(month, 10) - 600 * k, month, "5m", n) for k in range(1, 3)]
            if fails:
                tickets.append((sid, off(month, 10), 1))
    names = feature_columns()
    df = spark.createDataFrame(rows, "sid long, predict_time string, t_predict long, month int, freq string, n int")
    df = df.select("*", *[(F.col("n") if c == "5min_counter" else F.lit(0)).alias(c) for c in names])
    data = experiments.Data({"5m": df}, make_tickets(spark, tickets), models_dir=str(tmp_path))
    grid = {"trees": [5], "depth": [3], "min_split": [2]}
    report = experiments.by_lead_time(data, types=[1], splits=[1], grid=grid)
    r = report.first()
    assert (r["f1"], r["n_useful"], r["n_useless"], r["selected_on"]) == (1, 4, 0, "test")
    again = experiments.replays(data, 4, ["5m"], types=[1], splits=[1]).first()
    assert again.asDict() == r.asDict()
    assert experiments.averages(report).first()["f1"] == 1
    assert experiments.by_feature_group(data, [1], [2], [1], grid).first()["f1"] == 0


def test_every_machine_is_fitted_with_few_positives(separable):
    few = separable.filter("class = 0 or sid = 8")
    scorer = models.fit("SVM", {"members": 10}, few)
    assert len(scorer.members) == 10
    assert scorer.score(few).filter("pred between 0 and 1").count() == few.count()


def test_bags_are_as_many_as_asked_and_of_both_classes(spark):
    rows = [(0, i, 1, float(i < 2), [float(i)]) for i in range(50)]
    train = spark.createDataFrame(rows, "cell int, sid long, t_predict long, class double, values array<double>")
    held = {}
    for r in bags.draw(train, [20, 3]).collect():
        for b in r.bags:
            held.setdefault(b, []).append(r.positive)
    assert sorted(held) == list(range(23)) and all(len(set(v)) == 2 for v in held.values())
    with pytest.raises(ValueError):
        bags.fit_bags(train.filter("class = 0"), [3])


def test_known_positives_by_ticket(spark):
    """An error 100 s before the ticket of month 6 does not count there, though the ticket of month 7 is far away."""
    log = make_log(spark, [(1, 3, 0, 0, 1, 1, 1, FAIL - 100)])
    inventory = make_inventory(spark, [(1, "A1", 8, "M1")])
    tickets = make_tickets(spark, [(1, FAIL, 1), (1, off(7, 9), 1)])
    found = {(r.failure_type, r.split): r.positives for r in evaluate.known_positives(log, tickets, inventory, labels.SPLITS).collect()}
    assert len(found) == 9 and {k for k, v in found.items() if v} == {(1, 2)}


def test_experiments_stage_each_pair_once_and_share_fits(spark, tmp_path):
    rows, tickets = [], []
    for month in range(1, 7):
        for s in range(12):
            sid, fails = month * 100 + s, s < 3
            rows += [(sid, f"p{k}", off(month, 10) - 600 * k, month, "5m", 40 if fails else 2) for k in range(1, 3)]
            if fails:
                tickets.append((sid, off(month, 10), 1))
    df = spark.createDataFrame(rows, "sid long, predict_time string, t_predict long, month int, freq string, n int")
    df = df.select("*", *[(F.col("n") if c == "5min_counter" else F.lit(0)).alias(c) for c in feature_columns()])
    data = experiments.Data({"5m": df}, make_tickets(spark, tickets), models_dir=str(tmp_path))
    grid = {"trees": [10], "depth": [5], "min_split": [5]}
    groups = experiments.by_feature_group(data, [1, 4], [1], [1], grid)
    lead = experiments.by_lead_time(data, [1], [1], grid)
    assert len(data.staged) == 1 and data.fits == 2   # experiment 4 takes experiment 1's forest on all features
    assert lead.first()["f1"] == {r["variant"]: r["f1"] for r in groups.collect()}["4"] == 1
    again = experiments.replays(data, 4, ["5m"], types=[1, 2], splits=[1]).orderBy("failure_type").collect()
    assert [r["f1"] for r in again] == [1, 0]


def test_boosted_trees_are_fitted_once_a_depth():
    assert len(models.candidates("GBDT")) == 6


@pytest.fixture(scope="module")
def noisy(spark):
    """Two cells that no model separates."""
    pick = random.Random(5)
    rows = []
    for i in range(600):
        label = float(pick.random() < .3)
        rows.append((1 + i % 2, 1, i, FAIL - 10 * (i % 70), label, [pick.gauss(label, 1), pick.gauss(-label, 2) * 1000, pick.random(), float(i % 3)]))
    return spark.createDataFrame(rows, "failure_type int, split int, sid long, t_predict long, class double, values array<double>").cache()


def in_cell(noisy, t):
    return noisy.filter(F.col("failure_type") == t).select("sid", "t_predict", "class", array_to_vector("values").alias("features"))


@pytest.mark.parametrize("name", ["RF", "GBDT", "LR", "MLP"])
def test_kernels_score_as_the_fitted_models_do(noisy, name):
    params = {"RF": {"trees": 12, "depth": 30, "min_split": 2}, "GBDT": {"trees": 8, "depth": 3, "leaves": 99}, "LR": {"c": .1},
              "MLP": {"layers": 2, "neurons": 4}}[name]
    rows = in_cell(noisy, 1)
    scorer = models.fit(name, params, rows)
    theirs = scorer.fitted[0].transform(rows).select("sid", vector_to_array("probability")[1].alias("p"))
    both = scorer.score(rows).join(theirs, "sid")
    assert both.count() == 300 and both.filter("abs(pred - p) > 1e-9").count() == 0


def test_points_of_a_forest_are_its_cut_trees(noisy):
    """Each point of a grid scores as a plain walk does that stops at its depth, or before it splits a small node."""
    points = models.parameter_space({"trees": [3, 9], "depth": [2, 6], "min_split": [2, 40]})
    scorer = models.fit_cells("RF", {(1, 1): points}, noisy, ["failure_type", "split"])[1, 1]
    model = scorer.fitted[0]
    rows = in_cell(noisy, 1).collect()
    got = scorer.kernel.probabilities(np.array([r.features.toArray() for r in rows]))

    def walk(node, x, depth, params):
        java = node
        if java.subtreeDepth() == 0 or depth >= params["depth"] or java.impurityStats().rawCount() < params["min_split"]:
            stats = list(java.impurityStats().stats())
            return stats[1] / sum(stats)
        left = java.split().threshold() >= x[java.split().featureIndex()]
        return walk(java.leftChild() if left else java.rightChild(), x, depth + 1, params)
    trees = list(model._java_obj.trees())
    for i in range(0, len(rows), 29):
        x = rows[i].features.toArray()
        for j, p in enumerate(points):
            want = np.mean([walk(t.rootNode(), x, 0, p) for t in trees[:p["trees"]]])
            assert got[i, j] == pytest.approx(want, abs=1e-12)
    assert len({tuple(got[:, j].round(6)) for j in range(len(points))}) > 4
    picked = kernels.pick(scorer.kernel, 5).probabilities(np.array([r.features.toArray() for r in rows]))
    assert (picked[:, 0] == got[:, 5]).all()


def test_rounds_of_boosting_are_prefixes(noisy):
    rows = in_cell(noisy, 2)
    both = models.fit_cells("GBDT", {(2, 1): [{"trees": n, "depth": 3, "leaves": 8} for n in (4, 9)]}, noisy, ["failure_type", "split"])[2, 1]
    assert len(both.fitted) == 1
    few = models.fit("GBDT", {"trees": 4, "depth": 3, "leaves": 8}, rows)
    x = np.array([r.features.toArray() for r in rows.collect()])
    assert np.allclose(both.kernel.probabilities(x)[:, 0], few.kernel.probabilities(x)[:, 0])


def test_boosted_trees_take_equal_rows_as_one(spark, noisy, monkeypatch):
    """Each row 3 or 20 times: the fit sees few rows, and is that of all of them."""
    many = noisy.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("sid") % 3 == 0, 20).otherwise(3)))).cache()
    seen, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    params, by = {"trees": 6, "depth": 3, "leaves": 8}, ["failure_type", "split"]
    scorer = models.fit_cells("GBDT", {(1, 1): [params], (2, 1): [params]}, many, by)
    for rows in seen:
        assert rows.count() == 200 + 100 * 3
        assert rows.agg(F.sum("weight")).first()[0] == pytest.approx(200 * 3 + 100 * 20) and rows.agg(F.max("weight")).first()[0] <= models.PIECE
    plain = models._fits("GBDT", [params], 1, 4)[0].copy()
    for t in (1, 2):
        rows = in_cell(many, t)
        x = np.array([r.features.toArray() for r in in_cell(noisy, t).collect()])
        want = models._scorer(spark, "GBDT", [params], [fit(plain, rows.withColumn("weight", F.lit(1.0)))])
        assert np.allclose(scorer[t, 1].kernel.probabilities(x), want.kernel.probabilities(x))


def test_networks_of_all_cells_are_fitted_together(spark, noisy, monkeypatch):
    """One job a pass whatever the number of networks, over equal rows as one; the loss is that of Spark ML's own fit of each, or less."""
    even = F.transform("values", lambda v, i: F.when(i == 1, v / 1000).otherwise(v))   # features of very unlike sizes have many local minima
    many = noisy.withColumn("values", even).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("sid") % 3 == 0, 3).otherwise(1))))
    many = many.drop("copy").cache()
    passes, run, fit, seen = [], networks._pass, models.MultilayerPerceptronClassifier.fit, []
    monkeypatch.setattr(networks, "_pass", lambda rows, nets, trial, sizes: passes.append((len(trial), rows.count())) or run(rows, nets, trial, sizes))
    monkeypatch.setattr(models.MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(self.getMaxIter()) or fit(self, rows))
    points, by = [{"layers": n, "neurons": 3} for n in (1, 20)], ["failure_type", "split"]
    found = models.fit_cells("MLP", {(1, 1): points, (2, 1): points}, many, by)
    assert set(seen) == {0} and passes[0] == (4, 600) and len(passes) < 2 * networks.ITERATIONS and passes[-1][0] < 4
    for t in (2,):
        rows = in_cell(many, t)
        held = rows.collect()
        x, positive = np.array([r.features.toArray() for r in held]), np.array([r["class"] == 1 for r in held])
        for i, layers in enumerate(([4, 3, 2], [4, *[3] * 20, 2])):
            def loss(w):
                sums = np.zeros(1 + len(w))
                networks.add_loss(w, layers, x, positive, np.ones(len(x)), sums)
                return sums / len(x)
            theirs = fit(models.MultilayerPerceptronClassifier(labelCol="class", layers=layers, seed=models.SEED), rows)
            assert found[t, 1].fitted[i].getLayers() == layers
            assert loss(found[t, 1].fitted[i].weights.toArray())[0] <= loss(theirs.weights.toArray())[0] + 0.01
            w = np.random.default_rng(2).normal(size=len(theirs.weights.toArray()))
            for j in range(0, len(w), 7):
                e = 1e-6 * (np.arange(len(w)) == j)
                assert loss(w)[1 + j] == pytest.approx((loss(w + e)[0] - loss(w - e)[0]) / 2e-6, abs=1e-6)


def test_networks_refuse_what_is_not_finite(spark):
    rows = [(i, 1, float(i % 2), [float("nan") if i == 3 else float(i)]) for i in range(20)]
    train = spark.createDataFrame(rows, "sid long, t_predict long, class double, values array<double>")
    with pytest.raises(ArithmeticError):
        models.fit_cells("MLP", {(): [{"layers": n, "neurons": 2} for n in (1, 2)]}, train)


def test_bags_of_all_cells_are_fitted_together(spark, noisy, monkeypatch):
    """As each cell alone, with as many jobs whatever the number of bags; near the least loss."""
    by = ["failure_type", "split"]
    together = bags.fit_bags(noisy, [4, 2], by, passes=40)
    assert set(together) == {(1, 1), (2, 1)} and {n: w.shape for n, w in together[1, 1].items()} == {4: (4, 5), 2: (2, 5)}
    alone = bags.fit_bags(noisy.filter("failure_type = 2").drop("failure_type", "split"), [4, 2], passes=40)[()]
    for n in (4, 2):
        assert np.allclose(together[2, 1][n], alone[n], rtol=1e-3, atol=1e-3)
    passes = []
    run = bags._pass
    monkeypatch.setattr(bags, "_pass", lambda *a: passes.append(1) or run(*a))
    bags.fit_bags(noisy, [30], by, passes=5)
    assert len(passes) <= 6
    whole = bags.fit_bags(noisy.filter("failure_type = 1").drop("failure_type", "split"), [1])[()][1][0]
    data = noisy.filter("failure_type = 1").collect()
    x, y = np.array([r["values"] for r in data]), np.array([2 * r["class"] - 1 for r in data])
    deviations = x.std(0)

    def loss(w):
        return np.mean(np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) ** 2) + bags.PENALTY / len(x) * ((w[:-1] * deviations) ** 2).sum() / 2
    rng = np.random.default_rng(1)
    assert all(loss(whole) <= loss(whole + np.r_[rng.normal(size=4) / deviations, rng.normal()] * e) + 1e-6 for e in (.5, .1, .02) for _ in range(40))


def test_weights_must_be_finite(spark):
    rows = [(i, 1, float(i % 2), [float("nan") if i == 3 else float(i)]) for i in range(20)]
    with pytest.raises(ArithmeticError):
        bags.fit_bags(spark.createDataFrame(rows, "sid long, t_predict long, class double, values array<double>"), [2])


def test_all_cells_in_one_pass_equal_each_alone(spark):
    pick = random.Random(9)
    rows = spark.createDataFrame([(s, f"p{m}-{k}", off(m, 1 + 3 * k), m) for s in range(1, 25) for m in range(1, 9) for k in range(6)],
                                 "sid long, predict_time string, t_predict long, month int").cache()
    tickets = make_tickets(spark, [(s, off(pick.randrange(1, 9), pick.randrange(1, 28)), pick.randrange(4)) for s in range(1, 20) for _ in range(1 + s % 2)])
    for role, make in (("train", labels.train_labels), ("test", labels.test_labels)):
        together = labels.cell_labels(rows, tickets, role, horizon=9 * 86400)
        plan = together._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and plan.count("InMemoryRelation") == 1
        found, wanted = Counter(tuple(r) for r in together.collect()), Counter()
        for t in (1, 2, 3):
            for s, (train, test) in labels.SPLITS.items():
                own = make(rows.filter(F.col("month").isin(train if role == "train" else [test])), tickets, t, 9 * 86400)
                wanted.update((*r[:-1], t, s, r[-1]) for r in own.collect())
        assert found == wanted
        if role == "train":
            sampled = Counter(tuple(r) for r in labels.under_sample(together, .5, by=["failure_type", "split"]).collect())
            wanted = Counter()
            for t in (1, 2, 3):
                for s in (1, 2, 3):
                    own = together.filter((F.col("failure_type") == t) & (F.col("split") == s))
                    wanted.update(tuple(r) for r in labels.under_sample(own, .5).collect())
                    positives = own.filter("class = 1").count()
                    assert sum(v for k, v in wanted.items() if k[4:6] == (t, s) and k[6] == 0) == min(2 * positives, own.filter("class = 0").count())
            assert sampled == wanted
        listed = labels.cell_labels(rows, tickets, role, horizon=9 * 86400, exploded=False)
        assert Counter(tuple(r) for r in listed.select("sid", "predict_time", "t_predict", "month", F.inline("uses")).collect()) == found


def test_lead_times_of_all_thresholds_equal_one_by_one(spark):
    pick = random.Random(11)
    rows = [(1 + i % 2, pick.randrange(12), FAIL - 60 * pick.randrange(40), int(pick.random() < .6), pick.choice([pick.random(), .3, 1.0, 0.0]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "g int, sid long, t_predict long, class int, pred double").cache()
    tickets = make_tickets(spark, [(s, FAIL + 60 * (s % 5), 1) for s in range(10)] + [(2, FAIL - 600, 2)])
    found = {(r.g, round(100 * r.threshold)): (r.n_useless, r.n_useful) for r in evaluate.lead_sweep(df, tickets, ["g"]).collect()}
    for i in (0, 5, 29, 30, 31, 60, 95, 99):
        for r in evaluate.lead_time(df, tickets, i / 100, ["g"]).collect():
            assert found.get((r.g, i), (0, 0)) == (r.n_useless, r.n_useful)


def test_a_grid_is_one_scan_and_equals_each_point_alone(spark, noisy):
    """Metrics of all points of a grid against scoring and evaluating each point by itself."""
    by = ["failure_type", "split"]
    points = models.parameter_space({"trees": [2, 7], "depth": [2, 8], "min_split": [2, 30]})
    scorers = models.fit_cells("RF", {(1, 1): points, (2, 1): points}, noisy, by)
    use = F.struct("failure_type", "split", F.col("class").cast("int").alias("class"))
    test = noisy.select((F.col("sid") % 90).alias("sid"), "t_predict", F.array(use).alias("uses"), "values")
    scored = experiments.score_grid(test, scorers)
    found = {(r.failure_type, r.candidate): r for r in experiments.evaluate_grid(scored, len(points)).collect()}
    assert len(found) == 2 * len(points)
    leads = {(r.failure_type, r.candidate, r.threshold): (r.n_useless, r.n_useful) for r in experiments.lead_times(
        scored, make_tickets(spark, [(s, FAIL + 600 * (s % 4 - 1), 1) for s in range(0, 90, 2)])).collect()}
    for t in (1, 2):
        for i in (0, 3, 7):
            rows = in_cell(noisy, t).withColumn("sid", F.col("sid") % 90)
            alone = scorers[t, 1].point(i).score(rows)
            want = evaluate.best_threshold(alone).first()
            assert all(found[t, i][c] == pytest.approx(want[c]) if want[c] is not None else found[t, i][c] is None for c in want.asDict())
            lead = evaluate.lead_time(alone, make_tickets(spark, [(s, FAIL + 600 * (s % 4 - 1), 1) for s in range(0, 90, 2)]), .25).first()
            assert leads.get((t, i, .25), (0, 0)) == (lead.n_useless, lead.n_useful)


def test_a_score_that_is_not_finite_raises(spark, noisy):
    scorer = models.Scorer("SVM", [{"members": 1}], kernels.Linear([np.array([[float("nan")] * 5])]))
    test = noisy.select("sid", "t_predict", F.array(F.struct("failure_type", "split", F.col("class").cast("int").alias("class"))).alias("uses"), "values")
    with pytest.raises(Exception, match="not finite"):
        experiments.score_grid(test, {(1, 1): scorer})


def test_an_experiment_on_some_cells_stages_no_others(spark):
    rows = [(100 * month + s, f"p{k}", off(month, 10) - 600 * k, month, "5m", 1) for month in range(1, 9) for s in range(6) for k in (1, 2)]
    df = spark.createDataFrame(rows, "sid long, predict_time string, t_predict long, month int, freq string, n int")
    df = df.select("*", *[F.col("n").alias(c) for c in feature_columns()])
    tickets = make_tickets(spark, [(100 * month + s, off(month, 10), 1 + s) for month in range(1, 9) for s in range(3)])
    data = experiments.Data({"5m": df}, tickets)
    train, test, learnable = experiments._staged(data, "5m", [(1, 1), (2, 1)])
    assert {(r.failure_type, r.split) for r in train.select("failure_type", "split").distinct().collect()} == {(1, 1), (2, 1)} == learnable
    assert {(r.failure_type, r.split) for r in test.select(F.inline("uses")).collect()} == {(1, 1), (2, 1)}
    experiments._staged(data, "5m", [(2, 1), (1, 1)])
    assert len(data.staged) == 1


def test_large_fits_run_one_by_one(spark, noisy, monkeypatch):
    """Each fit caches its rows: those that run at a time have FIT_BYTES of rows together."""
    assert models.threads([1]) == models.THREADS
    assert models.threads([5, models.FIT_BYTES // 3]) == 3 and models.threads([10 * models.FIT_BYTES]) == 1
    pools, pool = [], models.ThreadPoolExecutor
    monkeypatch.setattr(models, "ThreadPoolExecutor", lambda n: pools.append(n) or pool(n))
    monkeypatch.setattr(models, "FIT_BYTES", 1)
    points = {(c,): [{"c": 0.1}] for c in (1, 2)}
    assert set(models.fit_cells("LR", points, noisy, ["failure_type"])) == set(points) and pools[0] == 1


def test_a_pass_of_the_bags_equals_its_sums_row_by_row(spark):
    """Loss and gradient of every machine of two cells, against plain sums; values travel packed, rows in no bag not at all."""
    rng = np.random.default_rng(3)
    rows = [(c, f"s{i}", i, float(rng.integers(2)), rng.normal(size=3).tolist()) for c in range(2) for i in range(90)]
    train = spark.createDataFrame(rows, "cell int, sid string, t_predict long, class double, values array<double>")
    drawn = bags.draw(train, [4, 2])
    assert dict(drawn.dtypes)["values"] == "binary"
    held = [(r.cell, 1.0 if r.positive else -1.0, np.frombuffer(r["values"]), r.bags) for r in drawn.collect()]
    assert 0 < len(held) < len(rows) and all(b for *_, b in held)
    assert {tuple(x) for _, _, x, _ in held} <= {tuple(v) for *_, v in rows}
    weights, scale = rng.normal(size=(12, 4)), rng.uniform(.5, 2, size=(2, 3))
    want = np.zeros((12, 6))
    for c, y, x, own in held:
        for b in own:
            z = np.r_[x / scale[c], 1]
            gap = max(0, 1 - y * (z @ weights[c * 6 + b]))
            want[c * 6 + b] += np.r_[1, gap * gap, -2 * gap * y * z]
    n, loss, gradient = bags._pass(drawn, weights, scale)
    assert (n == want[:, 0]).all() and (n > 0).all()
    assert np.allclose(loss, want[:, 1] / n) and np.allclose(gradient, want[:, 2:] / n[:, None])


def test_forests_keep_the_nodes_rows_have_reached(noisy):
    """Deep trees are not walked from the root at every level; they are the same trees."""
    estimator, = models._fits("RF", [{"trees": 5, "depth": 50, "min_split": 5}], 100, 4)
    assert estimator.getCacheNodeIds()
    rows = in_cell(noisy, 2)
    kept, walked = (estimator.copy({estimator.cacheNodeIds: keep}).fit(rows) for keep in (True, False))
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]


def test_a_fit_has_partitions_for_its_rows(spark, monkeypatch, tmp_path):
    """Rows of one file, read as one partition, are dealt by their number; few rows are merged."""
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("id AS sid", "id AS t_predict").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    monkeypatch.setattr(models, "ROWS", 50)
    assert rows.rdd.getNumPartitions() < 20 and models._dealt(rows, 1000).rdd.getNumPartitions() == 20
    monkeypatch.setattr(models, "ROWS", 50_000)
    assert models._dealt(spark.range(0, 1000, 1, 8).selectExpr("id AS sid", "id AS t_predict"), 1000).rdd.getNumPartitions() == 1


def test_a_tree_counts_the_rows_that_were_drawn():
    """Every node's rows, by a walk of all drawn rows; no split is missed that a plain search over the drawn features finds."""
    rng = np.random.default_rng(5)
    x, weight = rng.integers(0, 6, (400, 3)).astype(np.uint8), rng.integers(1, 4, 400)
    positive = (rng.random(400) < x[:, 0] / 6).astype(np.uint8)
    drawn = np.random.default_rng([42, 1]).poisson(weight)
    feature, limit, left, right, counts = forests.grow(x, positive, weight, 6, [42, 1], 30)
    at, depth = [(0, np.flatnonzero(drawn))], 0
    while at:
        following = []
        for node, rows in at:
            assert counts[node].tolist() == np.bincount(positive[rows], drawn[rows], 2).tolist()
            if feature[node] >= 0:
                low = x[rows, feature[node]] <= limit[node]
                assert 0 < low.sum() < len(rows) and node < left[node]
                following += [(left[node], rows[low]), (right[node], rows[~low])]
                sisters = left[node], right[node]
                says = [counts[s][1] > counts[s][0] for s in sisters]
                assert says[0] != says[1] or any(feature[s] >= 0 for s in sisters)   # else they are one leaf
        at, depth = following, depth + 1
    assert depth > 4
    shallow = forests.grow(x, positive, weight, 6, [42, 1], 2, 50)
    assert len(shallow[0]) <= 7 and all(shallow[4][i].sum() >= 50 for i in np.flatnonzero(shallow[0] >= 0))


def test_limits_are_between_values_or_at_even_steps():
    assert forests.limits([3, 1, 1, 5]).tolist() == [2, 4] and forests.limits([7, 7]).tolist() == []
    even = forests.limits(np.arange(3200) // 10)
    assert len(even) == forests.BINS - 1 and np.allclose(np.diff(even), 10)


def test_grids_of_forests_are_grown_together(spark, noisy, monkeypatch):
    """No Spark ML fit on the rows; equal rows are one with a weight; a cell grown beside others is the same as alone, and near Spark ML's."""
    plain = models._fits("RF", [{"trees": 60, "depth": 6, "min_split": 2}], 300, 4)[0].fit(in_cell(noisy, 1))
    many = noisy.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy").cache()
    seen, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    sizes, real = [], forests._grown
    monkeypatch.setattr(forests, "_grown", lambda plan, n, *rest: sizes.append(n) or real(plan, n, *rest))
    by, points = ["failure_type", "split"], models.parameter_space({"trees": [60], "depth": [6], "min_split": [2, 40]})
    both = models.fit_cells("RF", {(1, 1): points, (2, 1): points}, noisy, by)
    alone = models.fit_cells("RF", {(2, 1): points}, noisy, by)
    models.fit_cells("RF", {(1, 1): points}, many, by)
    assert not seen and max(sizes[2].values()) <= 300
    x = np.array([r.features.toArray() for r in in_cell(noisy, 1).collect()])
    assert (both[2, 1].kernel.probabilities(x) == alone[2, 1].kernel.probabilities(x)).all()
    theirs = np.array([r.p for r in plain.transform(in_cell(noisy, 1)).select(vector_to_array("probability")[1].alias("p")).collect()])
    ours = both[1, 1].kernel.probabilities(x)[:, 0]
    assert abs(ours - theirs).mean() < 0.06 and np.corrcoef(ours, theirs)[0, 1] > 0.95
    monkeypatch.setattr(forests, "BYTES", 1)   # rows that no task can hold are left to Spark ML
    assert set(models.fit_cells("RF", {(1, 1): points}, noisy, by)) == {(1, 1)} and seen == [300]


def test_forests_refuse_what_is_not_finite(spark):
    rows = [(i, 1, float(i % 2), [float("nan") if i == 3 else float(i)]) for i in range(20)]
    train = spark.createDataFrame(rows, "sid long, t_predict long, class double, values array<double>")
    with pytest.raises(Exception, match="not finite"):
        models.fit_cells("RF", {(): [{"trees": 3, "depth": 3, "min_split": n} for n in (2, 5)]}, train)


def test_trees_travel_without_the_values_of_all_shapes(noisy):
    """The columns of a grid's shapes are made where rows are scored."""
    points = models.parameter_space({"trees": [9], "depth": [2, 4, 6], "min_split": [2, 20, 40]})
    trees = models.fit_cells("RF", {(1, 1): points}, noisy, ["failure_type", "split"])[1, 1].kernel.trees
    before = len(pickle.dumps(trees))
    assert trees.values.shape == (len(trees.feature), 9) and len(pickle.dumps(trees)) == before
    assert (pickle.loads(pickle.dumps(trees)).values == trees.values).all()


def test_machines_are_fitted_where_their_rows_are(noisy, monkeypatch):
    """No pass over all rows, and the weights that joint passes give; bags that no task can hold take these."""
    by, passes, run = ["failure_type", "split"], [], bags._pass
    monkeypatch.setattr(bags, "_pass", lambda *a: passes.append(1) or run(*a))
    own = bags.fit_bags(noisy, [4, 7], by)
    assert not passes
    monkeypatch.setattr(bags, "BYTES", 1)
    joint = bags.fit_bags(noisy, [4, 7], by)
    assert passes and set(own) == set(joint)
    assert all(np.allclose(own[c][n], joint[c][n], rtol=1e-3, atol=1e-3) for c in own for n in (4, 7))


def test_a_network_of_many_rows_is_fitted_in_passes(noisy, monkeypatch):
    """Not by Spark ML, whose fit keeps two copies of its rows; more rows than may be cached are read from a compressed table."""
    seen, fit = [], models.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(models.MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(self.getMaxIter()) or fit(self, rows))
    monkeypatch.setattr(models, "ROWS", 100)
    params, rows = {"layers": 1, "neurons": 4}, in_cell(noisy, 1)
    cached = models.fit("MLP", params, rows)
    codecs, real = [], networks.stage
    monkeypatch.setattr(networks, "stage", lambda df, by=(), codec=None: codecs.append(codec) or real(df, by, codec))
    monkeypatch.setattr(networks, "BYTES", 1)
    staged = models.fit("MLP", params, rows)
    assert set(seen) == {0} and codecs == ["zstd"]
    x = np.array([r.features.toArray() for r in rows.collect()])
    assert np.allclose(cached.kernel.probabilities(x), staged.kernel.probabilities(x), atol=1e-3)
