"""Sharding by balanced label propagation: linked documents move to their neighbours' shards within byte quotas."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import small, stage

LAW = "bytes"
RANGE_BITS = 10  # of the hash order, for prefix sums
ROUNDS = 4
FILL = 0.97      # of a shard's equal part that linked documents may take by propagation


def _running(df, keys, value, name):
    """``df`` (staged) with the sum of ``value`` over earlier rows of the same ``keys`` in the order of the hash ``h``:
    sums over ranges of the hash, and within a range; no group passes through one task."""
    ranged = df.withColumn("_range", F.shiftright("h", 64 - RANGE_BITS))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*keys, "_range").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))) \
        .join(small(starts), [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_in")) \
        .drop("_range", "_in", "_start")


def _loads(df, shards):
    """Bytes of each shard, on the driver: as many numbers as shards."""
    found = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("size")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _propagate(linked, shards, capacity):
    """One round. Votes are rows of (group, shard), summed before they are shuffled. The documents of a group in one
    shard want to move to the open shard with most of the group's documents; a shard takes newcomers in hash order of
    their groups up to its quota, of the group that reaches it only a part. None if nothing wants to move."""
    votes = stage(linked.groupBy("g", "crc", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    has = _loads(votes.withColumnRenamed("bytes", "size"), shards)
    is_open = F.array(*[F.lit(has[s] < capacity) for s in range(shards)])
    strength = F.struct(F.col("n"), F.xxhash64("g", "shard").alias("tie"), F.col("shard").alias("to"))
    goals = votes.where(F.element_at(is_open, F.col("shard") + 1)).groupBy("g", "crc").agg(F.max(strength).alias("goal"))
    wishes = votes.join(small(stage(goals)), ["g", "crc"], "left").withColumn(
        "moves", F.coalesce(F.col("goal") > strength, F.lit(False)))
    wishes = stage(wishes.select("g", "crc", "shard", "bytes", "n", F.col("goal.to").alias("to"), "moves"))
    if not wishes.where("moves").limit(1).count():
        return None
    stays = _loads(wishes.where("NOT moves").withColumnRenamed("bytes", "size"), shards)
    quota = F.element_at(F.array(*[F.lit(float(max(0.0, capacity - s))) for s in stays]), F.col("to") + 1)
    moving = stage(wishes.where("moves").groupBy("g", "crc", "to").agg(F.sum("bytes").alias("bytes"))
                   .withColumn("h", F.xxhash64("g", "crc")).withColumn("row", F.col("g")))
    shares = _running(moving, ["to"], "bytes", "before").select(
        "g", "crc", "to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (quota - F.col("before")) / F.col("bytes"))).alias("share"))
    taken = wishes.where("moves").select("g", "crc", "shard").join(stage(shares.where("share > 0")), ["g", "crc"])
    taken = small(stage(taken.select("g", "crc", "shard", "to", "share")))
    chance = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return stage(linked.join(taken, ["g", "crc", "shard"], "left").select(
        "row", "g", "crc", "size", "h", F.when(chance < F.col("share"), F.col("to")).otherwise(F.col("shard")).alias("shard")))


def _levelled(loads, amount):
    """What each shard gets of ``amount`` so that the smallest loads rise to one level."""
    order = sorted(range(len(loads)), key=loads.__getitem__)
    got = [0.0] * len(loads)
    for k in range(len(order), 0, -1):
        level = (amount + sum(loads[s] for s in order[:k])) / k
        if level >= loads[order[k - 1]]:
            for s in order[:k]:
                got[s] = level - loads[s]
            break
    return got


def _fill(free, loads, shards):
    """Deal out documents without links: by size classes, large ones first, each class in hash order cut where the
    shards are level again. What a cut misses by is less than a document of the class, and later classes even it out."""
    free = free.withColumn("class", F.greatest(F.lit(2), F.floor(F.log2("size") / 2)).cast("int"))
    placed = stage(_running(stage(free), ["class"], "size", "before"))
    totals = {r[0]: r[1] for r in placed.groupBy("class").agg(F.sum("size")).collect()}  # one row a power of 4
    out = None
    for c in sorted(totals, reverse=True):
        bounds, at = [], 0.0
        for part in _levelled(loads, totals[c])[:-1]:
            at += part
            bounds.append(at)
        shard = sum((F.when(F.col("before") + F.col("size") / 2 >= b, 1).otherwise(0) for b in bounds), F.lit(0))
        mine = placed.where(F.col("class") == c).withColumn("shard", shard.cast("int")).select("row", "shard", "size")
        loads = [a + b for a, b in zip(loads, _loads(mine, shards))]
        out = mine if out is None else out.unionByName(mine)
    return out


def shard_documents(docs: DataFrame, shards=16, rounds=ROUNDS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Documents of equal texts are linked. All start in the shard of their hash; in each round the linked ones move
    towards the shard of most of their neighbours while it is below its quota (``_propagate``), which leaves few links
    cut: a group larger than a shard's room is split over few shards. Then the documents without links level the
    shards (``_fill``); linked documents beyond a shard's equal part are dealt out with them. Slots number the rows of a
    shard from 0 in hash order.

    A null text counts as an empty one. Null or repeated ids are rows of their own. An empty table gives no rows."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    nodes = stage(docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("g"), F.xxhash64(docs[id_col], text).alias("h"), F.monotonically_increasing_id().alias("row")))
    total, = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = stage(nodes.groupBy("g", "crc").agg(F.count("*").alias("n")).where("n > 1").select("g", "crc"))
    groups = small(groups)
    linked = stage(nodes.join(groups, ["g", "crc"], "left_semi").select(
        "row", "g", "crc", "size", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard")))
    part = total / shards
    for _ in range(rounds):
        moved = _propagate(linked, shards, FILL * part)
        if moved is None:
            break
        linked = moved
    loads = _loads(linked, shards)
    free = nodes.join(groups, ["g", "crc"], "left_anti").select("row", "size", "h")
    if any(load > part for load in loads):
        linked = stage(_running(linked, ["shard"], "size", "before"))
        free = free.unionByName(linked.where(F.col("before") + F.col("size") > part).select("row", "size", "h"))
        linked = linked.where(F.col("before") + F.col("size") <= part)
        loads = _loads(linked, shards)
    homes = linked.select("row", "shard")
    filled = _fill(free, loads, shards)
    if filled is not None:
        homes = homes.unionByName(filled.select("row", "shard"))
    placed = stage(nodes.join(homes, "row").withColumn("one", F.lit(1).cast("long")))
    return _running(placed, ["shard"], "one", "slot").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
