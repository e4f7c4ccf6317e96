"""Counter, statistical and one-hot features per (server, active window)."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.constants import COMPONENTS, LEVELS
from memsight.functions.topology import with_topology
from memsight.operators.windows import GRID, in_month
from memsight.session import tasks

PREFIX = "5min_"   # fixed value: the prefix of all windowed features, whatever the frequency
COUNTERS = ["counter", "mtbe", "read", "scrub", "soft", "hard"]

# The keys of the statistical levels. The slot in the channel and the rank are not in them.
STAT_LEVELS = {
    "socket": ["socketid"],
    "channel": ["socketid", "channelid"],
    "bank": ["socketid", "channelid", "bankid"],
    "row": ["socketid", "channelid", "bankid", "row_no"],
    "col": ["socketid", "channelid", "bankid", "col_no"],
    "cell": ["socketid", "channelid", "bankid", "row_no", "col_no"],
}
STATS = ["count", "mean", "median", "std"]


def counter_features(cells: DataFrame) -> DataFrame:
    """Errors, mean gap, reads, scrubs, and errors on soft and hard cells, in the window.

    The mean gap of ordered times is (last - first) / (n - 1); 0 for a single error."""
    n = F.sum("n")
    hard = F.sum(F.when(F.col("is_hard"), F.col("n")).otherwise(0))
    gap = F.when(n > 1, (F.max("last_t") - F.min("first_t")) / (n - 1)).otherwise(0.0)
    return in_month(cells).groupBy(*GRID).agg(
        n.alias(PREFIX + "counter"), gap.alias(PREFIX + "mtbe"),
        F.sum("reads").alias(PREFIX + "read"), F.sum("scrubs").alias(PREFIX + "scrub"),
        (n - hard).alias(PREFIX + "soft"), hard.alias(PREFIX + "hard"))


def statistical_features(cells: DataFrame, compat_swap=False) -> DataFrame:
    """Number of groups and mean, median and sample deviation of errors per group, at six levels.

    Groups without a key (NULL row or column number) are left out. One grouping-sets pass counts
    all levels, in place: the cells' rows, which are counted (hand in a staged table), are dealt by window
    once. Equal counts of a window and level are combined before the median looks for its place among them: few rows are left
    even of the largest window, as k distinct counts need k^2 / 2 errors, and they are sorted, not held by an aggregation.
    ``compat_swap``: give median the deviation's value and the other way round, as published files do.
    """
    cells = with_topology(in_month(cells.repartition(tasks(cells), *GRID)))
    keys = ["socketid", "channelid", "bankid", "row_no", "col_no"]
    small = cells.groupBy(*GRID, *keys).agg(F.sum("n").alias("n"))
    # a level's name for each set of address columns it keeps; complete keys only
    levels = [
        F.struct(F.lit(level).alias("level"), *[(F.col(k) if k in kept else F.lit(None).cast("long")).alias(k) for k in keys])
        for level, kept in STAT_LEVELS.items()
    ]
    complete = [F.when(reduce(and_, [F.col(k).isNotNull() for k in kept]), s)
                for kept, s in zip(STAT_LEVELS.values(), levels)]
    expanded = small.select(*GRID, "n", F.explode(F.array(*complete)).alias("g")).filter(F.col("g").isNotNull())
    groups = expanded.select(*GRID, "n", "g.*").groupBy(*GRID, "level", *keys).agg(F.sum("n").alias("n"))
    alike = groups.groupBy(*GRID, "level", "n").agg(F.count(F.lit(1)).alias("f"))
    n, f = F.col("n"), F.col("f")
    along = W.partitionBy(*GRID, "level").orderBy("n")
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    alike = alike.withColumns({"upto": F.sum("f").over(along.rowsBetween(W.unboundedPreceding, 0)),
                               "size": F.sum("f").over(whole), "total": F.sum(n * f).over(whole)})
    mean = F.col("total") / F.col("size")
    middle = [(F.col("upto") >= at) & (F.col("upto") - f < at) for at in (F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1)]
    alike = alike.withColumns({"mean": mean, "median": n * sum(m.cast("long") for m in middle) / 2, "square": f * (n - mean) * (n - mean)})
    aggs = []
    for level in STAT_LEVELS:
        def here(c):
            return F.when(F.col("level") == level, F.col(c))
        value = {"count": F.max(here("size")), "mean": F.max(here("mean")), "median": F.sum(here("median")),
                 "std": F.when(F.max(here("size")) > 1, F.sqrt(F.sum(here("square")) / (F.max(here("size")) - 1)))}
        if compat_swap:
            value["median"], value["std"] = value["std"], value["median"]
        aggs += [F.coalesce(value[s], F.lit(0)).alias(f"{PREFIX}{level}_{s}") for s in STATS]
    return alike.groupBy(*GRID).agg(*aggs)


ONE_HOT = {"DRAM_model": "model_", "DIMM_number": "dimm_num_", "server_manufacturer": "manufacturer_"}


def one_hot_table(inventory: DataFrame) -> DataFrame:
    """One row per server; a server listed twice has both levels set."""
    flags = [
        F.max(F.when(F.col(factor) == level, 1).otherwise(0)).alias(f"{prefix}{level}")
        for factor, prefix in ONE_HOT.items() for level in LEVELS[factor]
    ]
    return inventory.groupBy("sid").agg(*flags)


def one_hot_columns():
    return [f"{prefix}{level}" for factor, prefix in ONE_HOT.items() for level in LEVELS[factor]]


def with_one_hot(features: DataFrame, inventory: DataFrame) -> DataFrame:
    """Servers outside the inventory get all zeros. A server has at most a row per window of the
    calendar, so the join cannot be skewed by the size of its log."""
    return features.join(one_hot_table(inventory), "sid", "left").fillna(0, one_hot_columns())


def feature_columns(group=4):
    """The columns of feature groups 1..4 (6, 19, 37 and 52 features)."""
    columns = [PREFIX + c for c in COUNTERS]
    if group >= 2:
        columns += [f"{PREFIX}{c}_error" for c in COMPONENTS] + [f"{PREFIX}{level}_count" for level in STAT_LEVELS]
    if group >= 3:
        columns += [f"{PREFIX}{level}_{s}" for level in STAT_LEVELS for s in STATS[1:]]
    if group >= 4:
        columns += one_hot_columns()
    return columns
