"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import small, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BITS = 12  # 4096 ranges of the hash order in each source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size) -> also weight and target. Sources in the order of their code points, null last, get the
    weights in turn. Targets share ``share`` times all sizes by weight; a target stops at ``most`` times its source's
    size and the excess is shared again among the others until none is above.

    One row for each source: the levels are sums over them; each pass fixes at least one more source at its limit."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source, not for each document
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    table = stage(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int"))))
    total, = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level = 0.0
    limit = F.col("source_size") * most
    while True:
        full = limit <= F.col("weight") * level
        fixed, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not open_weight:
            break
        fresh = (share * total - fixed) / open_weight
        if fresh <= level:
            break
        level = fresh
    return table.withColumn("target", F.least(limit, F.col("weight") * level))


def mix(docs: DataFrame, seed=0, id_col="doc_id", text_col="text", source_col="source", keep=(),
        weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row of ``docs``, and the columns of ``docs`` that
    ``keep`` lists (under their own names, prefixed with ``kept_``).

    Each source is put into a hash-random order that depends on the row alone. Counts of words before a row are sums
    over ranges of the hash and sums within a range, so no source passes through one task. ``taken`` is the words of
    the row that the mix takes: whole epochs of the source while its target lasts, then rows in order until the exact
    budget, the last one in part.

    Null texts have no words and nothing is taken; a null source is a source of its own; null ids only make the order
    depend on the text. Of repeated rows (equal id and text) any may be the one that is cut: the results are the same
    up to the order of equal rows. An empty table gives no rows."""
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("of"),  # a key that is never null
        word_count(docs[text_col]).alias("size"), F.xxhash64(docs[id_col], docs[text_col], F.lit(seed)).alias("key"),
        *[docs[c].alias(f"kept_{c}") for c in keep]).withColumn("range", F.shiftright("key", 64 - BITS))
    if not keep:
        rows = stage(rows)
    sums = stage(rows.groupBy("of", "source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("of", "source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    starts = stage(starts.join(small(targets.drop("source")), "of").select("of", "range", "start", "source_size", "target"))
    order = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(small(starts), ["of", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size"))
    part = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), rest - F.col("start") - F.col("before")))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"),
        *[f"kept_{c}" for c in keep])


def mixed_documents(docs: DataFrame, seed=0, text_col="text", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, as often as whole epochs take them; the row at a source's budget is cut after
    its words taken (with the white space between them as it is). All columns stay, whatever their names.

    Null and empty texts have no words and are in no mix. Null sources, null ids, ties and repeated rows are taken as
    ``mix`` says. An empty table gives no rows."""
    made = mix(docs, seed, text_col=text_col, keep=docs.columns, **options)
    copies = made.where("taken > 0").withColumn("words", F.explode(F.expr(
        "transform(sequence(0L, (taken - 1) DIV greatest(size, 1L)), x -> least(size, taken - x * size))")))
    text = F.col(f"kept_{text_col}")
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    return copies.select(*[
        (F.when(F.col("words") < F.col("size"), cut).otherwise(text) if c == text_col else F.col(f"kept_{c}")).alias(c)
        for c in docs.columns])
