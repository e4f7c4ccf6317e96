"""Shapes shared by the findings: per-window columns, their unpivot, and complete row sets."""

from pyspark.sql import DataFrame, functions as F

from memsight.constants import FAILURE_TYPES, WINDOWS


def per_window(value, prefix, windows=WINDOWS, when=None):
    """One conditional sum per window: of ``value`` over rows with ``td`` above the window."""
    out = []
    for name, seconds in windows.items():
        condition = F.col("td") > seconds
        if when is not None:
            condition = condition & when
        out.append(F.sum(F.when(condition, value).otherwise(0)).alias(f"{prefix}_{name}"))
    return out


def unpivot_windows(df: DataFrame, keys, prefixes, windows=WINDOWS) -> DataFrame:
    """``prefix_1m .. prefix_30d`` columns to one row per window."""
    rows = [
        F.struct(F.lit(name).alias("window"), *[F.col(f"{p}_{name}").alias(p) for p in prefixes])
        for name in windows
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def other_types(tickets: DataFrame) -> DataFrame:
    """(failure_type): the positive types of tickets that are not among the published ones, mostly none."""
    kind = F.col("failure_type").cast("long")
    return tickets.filter((kind > 0) & ~kind.isin(list(FAILURE_TYPES))).select(kind.alias("failure_type")).distinct()


def scaffold(spark, windows=WINDOWS, others=None, **levels) -> DataFrame:
    """A row for every (failure_type, window, level): the rows a finding prints, empty or not. The failure types are the
    published ones and those of ``others``."""
    df = spark.range(1).select(F.explode(F.array(*[F.lit(t).cast("long") for t in FAILURE_TYPES])).alias("failure_type"))
    if others is not None:
        df = df.union(others)
    if windows is not None:
        df = df.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))
    for name, values in levels.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def fill(df: DataFrame, frame: DataFrame, keys, counts=()) -> DataFrame:
    """Left-join a result to its scaffold; absent counts are 0, absent means stay NULL."""
    out = frame.join(df, list(keys), "left")
    return out.fillna(0, list(counts)) if counts else out
