"""Small document tables with the awkward rows, and plain counterparts of the operators."""

import random

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# columns whose names the operators use themselves
EXTRA = T.StructType(DOCUMENT.fields + [T.StructField(n, T.StringType()) for n in (
    "size", "key", "shard", "score", "node", "words", "h", "hash", "print", "target", "range", "row", "copies", "label", "_id", "_hash", "added", "_added", "stays")])


def table(spark, rows, extra=True):
    """rows: (doc_id, text, source)"""
    full = [(i, t, "en", s, None if t is None else len(t)) + (("x",) * 19 if extra else ()) for i, t, s in rows]
    return spark.createDataFrame(full, EXTRA if extra else DOCUMENT).repartition(3)


def texts(n, seed=1, words=40):
    rng = random.Random(seed)
    some = ["the", "of", "and", "tion", "er", "mit", "license", "gnu", "general", "public", "apache", "by", "cc", "re", "über", "Été", "x1"]
    return [" ".join(rng.choice(some) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, words))) for _ in range(n)]


AWKWARD = [(None, "no id at all", "a"), (900, None, "a"), (901, "", None), (902, "   \n\t ", "b"), (903, "word", None),
           (904, "same text here", "c"), (904, "same text here", "c"), (905, "same text here", "c"), (906, "lone " * 3000, "b"),
           (907, "end\x0bof\x0cline", "é"), (None, None, None)]
