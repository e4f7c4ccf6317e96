"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import UnionFind, columns, components, fresh, small, stage, tidy
from llm.superminhash import band_keys, signatures
from llm.textops import SPACES, shingle_sets

SLOTS, BAND_ROWS = 252, 6   # 42 bands: a pair at 0.8 shares none with probability 3e-6
BLOCK_SHINGLES = 400_000    # of one side of a block of comparisons: 3.2 MB


def _sketch(k, slots, rows):
    def run(batches):
        for batch in batches:
            for first, values, bounds in shingle_sets(batch.column("text"), k, SPACES):
                n = len(bounds) - 1
                keys = band_keys(signatures(values, bounds, slots), rows).view(np.int64)
                raw = values.tobytes()
                prints = [hashlib.blake2b(raw[8 * bounds[i]:8 * bounds[i + 1]], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, n), batch.column("text_hash").slice(first, n),
                    pa.array(np.diff(bounds)), pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * keys.shape[1], keys.ravel()),
                ], ["doc_id", "text_hash", "n_shingles", "print", "bands"])
    return run


def _sets(k):
    def run(batches):
        for batch in batches:
            for first, values, bounds in shingle_sets(batch.column("text"), k, SPACES):
                n, raw = len(bounds) - 1, values.tobytes()
                sets = [raw[8 * bounds[i]:8 * bounds[i + 1]] for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(sets, pa.binary())], ["node", "members"])
    return run


def _verify(percent):
    """Links of one block: between its sides 0 and 1, or within side 0 if there is no other. Only links that join
    two groups not joined before are returned, so a block of n sets returns less than n rows."""
    def run(_, table):
        node = table.column("node").to_numpy()
        comp = table.column("comp").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
        _, forest_of = np.unique(comp, return_inverse=True)
        forest = UnionFind(int(forest_of.max()) + 1)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(two)
        if within:
            two = one
        elif len(one) > len(two):
            one, two = two, one
        out = []
        if len(one) and len(two):
            flat = np.concatenate([sets[i] for i in two])
            size = np.array([len(sets[i]) for i in two])
            offsets = np.concatenate([[0], np.cumsum(size)[:-1]])
            known, flat = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(known) + 1, np.int32)
            for x in one:
                at = np.searchsorted(known, sets[x])
                at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == sets[x])]
                mark[at] = 1
                both = np.add.reduceat(mark[flat], offsets)
                mark[at] = 0
                for y in two[100 * both >= percent * (len(sets[x]) + size - both)].tolist():
                    if forest.join(int(forest_of[x]), int(forest_of[y])):
                        out.append((node[x], node[y]))
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows (block columns g, i, j; side, node, comp) -> verified links."""
    full = rows.join(sets, "node").select("g", "i", "j", "side", "node", "comp", "members")
    return full.groupBy("g", "i", "j").applyInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=5, percent=80,
                    slots=SLOTS, band_rows=BAND_ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked if 100 * intersection >= percent * union of their sets of ``shingle``-word shingles
    (64-bit hashes of lower-cased words; a shorter text is one shingle); a component is what links reach.

    1. One pass computes each text's set, its fingerprint and SuperMinHash band keys. Equal sets are one class.
    2. Classes that share a band key hang on the bucket's smallest id, its leader.
    3. Leaders are compared with their members on full sets; union-find yields first components.
    4. Where a leader's group still has several components, everything outside the group's largest one is compared
       with the whole group, in blocks of bounded size. So each pair that shares a bucket is joined or compared.

    Null and empty texts have no shingles, link with nothing and are kept. A row without id is kept and has no
    component. Rows that repeat an id and a text are copies: all get the same result. Rows that repeat an id with
    other texts count by their own text. An empty table gives no rows."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    sketch = stage(rows.mapInArrow(
        tidy(_sketch(shingle, slots, band_rows)),
        "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>"))
    classes = stage(sketch.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("print")
                    .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"))
                    .select("print", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), "x.bands"))

    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = stage(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m"))
                    .where("m > 1").select("key", "leader"))
    members = stage(keyed.join(small(buckets), "key").where("node <> leader").select("leader", "node", "n").distinct())
    linked = members.select("node").union(members.select("leader")).distinct()
    wanted = small(stage(linked.withColumnRenamed("node", "doc_id")))
    sets = stage(rows.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(_sets(shingle)), "node long, members binary"))

    # leaders with their members
    blocks = members.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    blocks = stage(blocks)
    star = members.join(small(blocks), "leader").select(
        F.col("leader").alias("g"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j"),
        F.lit(0).alias("side"), "node", F.col("node").alias("comp"))
    heads = blocks.select(
        F.col("leader").alias("g"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"),
        F.lit(1).alias("side"), F.col("leader").alias("node"), F.col("leader").alias("comp"))
    first = stage(_links(star.unionByName(heads), sets, percent))
    comps = components(first)

    # what is outside the largest component of a leader's group, with the whole group
    group = members.unionByName(blocks.select("leader", F.col("leader").alias("node"), F.lit(0).cast("long").alias("n")))
    group = group.join(small(comps), "node", "left").select(
        "leader", "node", "n", F.coalesce("component", "node").alias("comp"))
    group = stage(group)
    parts = group.groupBy("leader", "comp").agg(F.sum("n").alias("n"))
    largest = parts.groupBy("leader").agg(
        F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("total"), F.count("*").alias("parts"))
    largest = stage(largest.where("parts > 1").select(
        "leader", F.col("x.comp").alias("major"),
        F.greatest(F.ceil(F.col("x.n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("many"),
        F.greatest(F.ceil((F.col("total") - F.col("x.n")) / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("few")))
    mine = group.join(small(largest), "leader").withColumn("outside", F.expr("comp <> major")).withColumn(
        "own", F.expr("CAST(pmod(xxhash64(node), IF(outside, few, many)) AS int)"))
    # blocks (i, j): j >= 0 is block j of the largest component, j < 0 is block -j - 1 of the rest
    placed = mine.select(F.col("leader").alias("g"), "node", "comp", F.explode(F.expr("""
        IF(outside,
           concat(transform(sequence(0, many - 1), x -> struct(own AS i, x AS j, 0 AS side)),
                  transform(sequence(0, few - 1), x -> struct(least(own, x) AS i, -greatest(own, x) - 1 AS j,
                                                              IF(x >= own, 0, 1) AS side))),
           transform(sequence(0, few - 1), x -> struct(x AS i, own AS j, 1 AS side)))""")).alias("at"))
    rest = stage(_links(placed.select("g", "at.i", "at.j", "at.side", "node", "comp"), sets, percent))
    found = components(first.unionByName(rest)) if rest.limit(1).count() else comps

    of_class = classes.select("print", "node").join(small(found), "node", "left").select(
        "print", F.coalesce("component", "node").alias("component"))
    repeated = stage(of_class)
    return sketch.drop("bands").join(repeated, "print", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of repeated rows, one). Rows without id,
    and null texts and texts without words under different ids, all stay. All columns stay, whatever their names. An empty table
    gives no rows."""
    found = stage(near_duplicates(docs, id_col, text_col, **options).where("doc_id IS NOT NULL"))
    counts = stage(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.min("component_id").alias("c")))
    chosen = counts.groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    judged = counts.join(chosen, "c").select(
        "doc_id", "text_hash", "copies",
        ((F.col("doc_id") == F.col("x.doc_id")) & F.col("text_hash").eqNullSafe(F.col("x.text_hash"))).alias("stays"))
    of, print_ = fresh(docs, "_id", "_hash")
    judged = stage(judged.where("copies > 1 OR NOT stays").select(F.col("doc_id").alias(of), F.col("text_hash").alias(print_), "stays"))
    same = lambda some: (docs[id_col] == some[of]) & (F.xxhash64(docs[text_col]) == some[print_])
    repeated = judged.where("stays")
    single = docs.join(small(judged), same(judged), "left_anti")
    again = docs.join(small(repeated), same(repeated), "left_semi")
    return single.unionByName(again.dropDuplicates([id_col, text_col]))
