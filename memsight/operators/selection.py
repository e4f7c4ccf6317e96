"""Exact medians of groups too large for one task."""

from pyspark.sql import DataFrame, Window as W, functions as F

CUTS = 200


def exact_median(df: DataFrame, keys, value, n_cuts=CUTS) -> DataFrame:
    """``keys``, ``n``, ``median`` of the non-null values.

    ``percentile_approx`` (a mergeable sketch) gives cut points; counts per interval between them
    say which interval holds the middle ranks, and only its distinct values are ordered. Any cut
    points give the exact answer; good ones make the ordered part about 1 / ``n_cuts`` of the group.
    Meant for few groups (a failure type and a window): their cut points are broadcast.
    """
    keys = list(keys)
    values = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_f"))
    )
    points = F.array(*[F.lit(i / n_cuts) for i in range(1, n_cuts)])
    cuts = values.groupBy(*keys).agg(
        F.percentile_approx("_v", points, F.lit(10 * n_cuts)).alias("_cuts"), F.sum("_f").alias("n"))
    placed = values.join(F.broadcast(cuts), keys).withColumn(
        "_b", F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))).drop("_cuts")

    ordered = W.partitionBy(*keys).orderBy("_b")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    intervals = placed.groupBy(*keys, "n", "_b").agg(F.sum("_f").alias("_in")).withColumn(
        "_upto", F.sum("_in").over(ordered))
    # at most two intervals per group hold the middle ranks
    middle = intervals.filter((F.col("_upto") >= low) & (F.col("_upto") - F.col("_in") < high)).select(
        *keys, "_b", (F.col("_upto") - F.col("_in")).alias("_before"))
    ranked = placed.join(F.broadcast(middle), [*keys, "_b"]).withColumn(
        "_rank", F.col("_before") + F.sum("_f").over(W.partitionBy(*keys, "_b").orderBy("_v")))
    first = F.col("_rank") - F.col("_f")
    return ranked.groupBy(*keys, "n").agg(
        ((F.min(F.when((first < low) & (F.col("_rank") >= low), F.col("_v")))
          + F.min(F.when((first < high) & (F.col("_rank") >= high), F.col("_v")))) / 2).alias("median"))
