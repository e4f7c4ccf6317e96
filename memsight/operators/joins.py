"""Joins of the large log with per-server tables, safe for a server that holds much of the log."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 << 20   # broadcast a side only if the optimizer bounds it by this
HEAVY_ROWS = 5_000_000       # a key with more rows is split into parts of about this many


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for scans, products for joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(*dims: DataFrame) -> bool:
    return all(estimated_bytes(d) <= BROADCAST_BYTES for d in dims)


def join_salted(fact: DataFrame, dim: DataFrame, keys, how="inner", heavy_rows=HEAVY_ROWS, counted=None) -> DataFrame:
    """Equi-join in which every key with more than ``heavy_rows`` fact rows is split.

    Heavy keys are counted first (map-side combined), in ``counted`` if it is cheaper to read than
    ``fact`` and has no fewer rows; there are at most rows / heavy_rows of them,
    which bounds what is broadcast (400,000 keys at 2 * 10^12 rows). Their fact rows get a part number
    from the row's content and the input partition, which a retried task repeats; their rows in
    ``dim`` are copied to every part. The result is partitioned by (key, part), so an aggregation
    that follows shuffles anew, after combining, instead of inheriting the skew.
    ``how``: inner, left or left_semi.
    """
    keys = list(keys)
    heavy = (
        (fact if counted is None else counted).groupBy(*keys).count().filter(F.col("count") > heavy_rows)
        .select(*keys, F.ceil(F.col("count") / heavy_rows).cast("int").alias("_parts"))
    )
    heavy = F.broadcast(heavy)
    parts = F.coalesce("_parts", F.lit(1))
    content = F.xxhash64(*[F.col(c) for c in fact.columns]) + F.spark_partition_id()
    left = fact.join(heavy, keys, "left").withColumn("_part", F.pmod(content, parts).cast("int")).drop("_parts")
    right = (
        dim.join(heavy, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def join_servers(fact: DataFrame, dim: DataFrame, how="inner", keys=("sid",)) -> DataFrame:
    """Join with a per-server table: broadcast if its size is bounded, split heavy keys otherwise."""
    if is_small(dim):
        return fact.join(F.broadcast(dim), list(keys), how)
    return join_salted(fact, dim, keys, how)


def join_counted(log: DataFrame, dims, columns) -> DataFrame:
    """Inner-join the log with per-server tables and keep ``columns`` and ``n``, a row multiplicity.

    Small tables: broadcast joins on the raw rows, ``n`` = 1; most rows drop out before any shuffle.
    Otherwise equal rows are counted first, so that no group of copies is shuffled row by row, and
    the counted rows are joined with heavy servers split. Sum ``n`` instead of counting rows.
    """
    rows = log.select("sid", *columns)
    if is_small(*dims):
        return reduce(lambda left, d: left.join(F.broadcast(d), "sid"), dims, rows).withColumn("n", F.lit(1))
    servers = reduce(lambda left, d: left.join(d, "sid"), dims)
    distinct = rows.groupBy("sid", *columns).agg(F.count(F.lit(1)).alias("n"))
    return join_salted(distinct, servers, ["sid"], counted=log)
