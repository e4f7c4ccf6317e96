"""Labels, month splits, under-sampling and training matrices."""

import itertools

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.operators.features import feature_columns

DAY = 86400

# Months to train on, and the month to test on, per split.
SPLITS = {1: ([1, 2, 3, 4, 5], 6), 2: ([2, 3, 4, 5, 6], 7), 3: ([3, 4, 5, 6, 7], 8)}
SAMPLE_RATIO = 0.02
SEED = 42


def _class(kind, failure_type, ahead, horizon, keep_others):
    """(whether a row is kept, its class) for a failure type; ``kind``: the type of the row's ticket, 0 without one."""
    own = kind == failure_type
    keep = (kind == 0) | (own & (ahead >= 0))
    if keep_others:
        keep = keep | ((kind > 0) & ~own)
    return keep, F.when(own & (ahead >= 0) & (ahead <= horizon), 1).otherwise(0)


def _with_tickets(features, tickets):
    # features hold at most a row per server and window of the calendar, so no server is heavy here
    facts = tickets.select("sid", F.col("failed_off").alias("_off"), F.col("failure_type").alias("_type"))
    return features.join(facts, "sid", "left"), F.coalesce("_type", F.lit(0)), F.col("_off") - F.col("t_predict")


def _labelled(features, tickets, failure_type, horizon, keep_others):
    rows, kind, ahead = _with_tickets(features, tickets)
    keep, label = _class(kind, failure_type, ahead, horizon, keep_others)
    return rows.filter(keep).withColumn("class", label).drop("_off", "_type")


def cell_labels(features: DataFrame, tickets: DataFrame, role: str, types=(1, 2, 3), splits=(1, 2, 3), horizon=DAY,
                exploded=True) -> DataFrame:
    """``features`` once for each cell (``failure_type``, ``split``) that uses the row in its ``role``, train or test, with its
    ``class``: the rows of ``train_labels`` or ``test_labels`` of all types and splits, from one scan and one join.

    ``exploded=False`` keeps one row for a feature row and ticket, with an array ``uses`` of (failure_type, split, class);
    rows without a use are dropped."""
    rows, kind, ahead = _with_tickets(features, tickets)
    entries = []
    for split in splits:
        months = SPLITS[split][0] if role == "train" else [SPLITS[split][1]]
        for failure_type in types:
            keep, label = _class(kind, failure_type, ahead, horizon, role == "test")
            entries.append(F.when(F.col("month").isin(months) & keep, F.struct(
                F.lit(failure_type).alias("failure_type"), F.lit(split).alias("split"), label.alias("class"))))
    uses = F.array_compact(F.array(*entries))
    if exploded:
        return rows.select(*features.columns, F.inline(uses))
    return rows.select(*features.columns, uses.alias("uses")).filter(F.size("uses") > 0)


def train_labels(features: DataFrame, tickets: DataFrame, failure_type: int, horizon=DAY) -> DataFrame:
    """Rows to train on: class 1 within ``horizon`` before a failure of the type, 0 earlier or
    without a ticket. Rows after the failure, and servers with other failures, are dropped."""
    return _labelled(features, tickets, failure_type, horizon, False)


def test_labels(features: DataFrame, tickets: DataFrame, failure_type: int, horizon=DAY) -> DataFrame:
    """As ``train_labels``, but servers with other failures stay as class 0, at all times."""
    return _labelled(features, tickets, failure_type, horizon, True)


def with_splits(features: DataFrame) -> DataFrame:
    """Each row once per split it is used in, with ``split`` and ``role``."""
    uses = [
        F.when(F.col("month").isin(months), F.struct(F.lit(split).alias("split"), F.lit(role).alias("role")))
        for split, (train, test) in SPLITS.items() for months, role in ((train, "train"), ([test], "test"))
    ]
    return features.select("*", F.inline(F.array_compact(F.array(*uses))))


def train_test(features: DataFrame, split: int):
    """The two parts of a split; on the feature store this prunes month directories."""
    train, test = SPLITS[split]
    return features.filter(F.col("month").isin(train)), features.filter(F.col("month") == test)


def _cuts(rows: DataFrame, ratio, by) -> DataFrame:
    """A row for each group ``by``: ``_cut``, the hash up to which rows of class 0 are taken, and ``_ties``, how many of those
    with just this hash. ``rows``: by, _h, _positive.

    A histogram of the first four digits (65,536 bars a group at most) gives the bar that holds the cut; only the
    hashes of that bar are ranked."""
    bar = F.substring("_h", 1, 4).alias("_p")
    histogram = rows.groupBy(*by, bar).agg(F.count_if("_positive").alias("_pos"), F.count_if(~F.col("_positive")).alias("_n"))
    group = W.partitionBy(*by)
    wanted = F.floor(F.sum("_pos").over(group) / F.lit(ratio))
    bars = histogram.withColumns({"_wanted": wanted, "_total": F.sum("_n").over(group), "_upto": F.sum("_n").over(group.orderBy("_p"))})
    take = F.col("_wanted") - (F.col("_upto") - F.col("_n"))
    edge = bars.withColumn("_take", take).filter((F.col("_take") > 0) & (F.col("_take") <= F.col("_n"))).select(*by, "_p", "_take")
    order = W.partitionBy(*by).orderBy("_h")
    ranked = rows.filter(~F.col("_positive")).withColumn("_p", bar).join(F.broadcast(edge), [*by, "_p"]).withColumns(
        {"_row": F.row_number().over(order), "_rank": F.rank().over(order)})
    exact = ranked.filter(F.col("_row") == F.col("_take")).select(
        *by, F.col("_h").alias("_at"), (F.col("_take") - F.col("_rank") + 1).alias("_some"))
    groups = bars.groupBy(*by).agg(F.max("_wanted").alias("_wanted"), F.max("_total").alias("_total"))
    everything = F.when(F.col("_wanted") > F.col("_total"), "g").otherwise("")   # hashes are hexadecimal
    return groups.join(exact, list(by), "left").select(
        *by, F.coalesce("_at", everything).alias("_cut"), F.coalesce("_some", F.lit(0)).alias("_ties"))


def under_sample(labelled: DataFrame, ratio=SAMPLE_RATIO, seed=SEED, keys=("sid", "predict_time"), by=()) -> DataFrame:
    """All rows of class 1 and a random floor(positives / ratio) rows of class 0; ratio 0 keeps all. ``by``: columns of
    groups that are sampled each on its own, in the same passes.

    Random order is the MD5 text of seed and key, the same on every run and engine. Two passes over the keys find the
    hash at which each group's sample ends (a row a group), the third keeps what is below it; only rows that are kept
    are shuffled.
    """
    if ratio == 0:
        return labelled
    groups = list(by) or ["_all"]
    hashed = labelled.withColumns({"_h": F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])),
                                   "_positive": F.col("class") == 1, **({} if by else {"_all": F.lit(1)})})
    cuts = _cuts(hashed.select(*groups, "_h", "_positive"), ratio, groups)
    near = hashed.join(F.broadcast(cuts), groups).filter(F.col("_positive") | (F.col("_h") <= F.col("_cut")))
    tie = F.row_number().over(W.partitionBy(*groups, "_h", "_positive").orderBy(F.lit(0)))
    kept = near.withColumn("_tie", tie).filter(F.col("_positive") | (F.col("_h") < F.col("_cut")) | (F.col("_tie") <= F.col("_ties")))
    return kept.select(*labelled.columns)


def select_features(labelled: DataFrame, group=4, keep=()) -> DataFrame:
    """Keys, the columns ``keep``, those of a feature group, and the class."""
    return labelled.select(*keep, "sid", "predict_time", "t_predict", *feature_columns(group), "class")


def values(group=4):
    """The features of a group as one array column of doubles; a smaller group's are the first of a larger one's."""
    return F.array(*[F.col(c).cast("double") for c in feature_columns(group)])


def matrix(labelled: DataFrame, group=4, keep=()) -> DataFrame:
    """``keep``, sid, predict_time, t_predict, class and the vector ``features``; keys stay out of the vector."""
    assembler = VectorAssembler(inputCols=feature_columns(group), outputCol="features")
    rows = select_features(labelled, group, keep).withColumn("class", F.col("class").cast("double"))
    return assembler.transform(rows).select(*keep, "sid", "predict_time", "t_predict", "class", "features")


def parameter_space(choices: dict) -> list:
    """All combinations of a dict of lists, as dicts."""
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]
