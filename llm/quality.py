"""Quality by hierarchical empirical Bayes: a text classifier's evidence, shrunk through hosts and paths."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import columns, fresh, small, stage, tidy
from llm.textops import SPACES, chunks, mix, text_bytes, word_hashes, words
from llm.toxicity import logistic

SAMPLE = 20_000  # labelled documents that the classifier is fitted on (on the driver, some features of each)
BINS = 8         # per feature
KEEP = 0.5       # posterior from which a document stays

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|<>{}[]\\^~_=+@/")] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?")] = True
LOUD = np.zeros(256, bool)
LOUD[list(b"!?")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
DIGITS = np.zeros(256, bool)
DIGITS[ord("0"):ord("9") + 1] = True
NAMES = ("words", "word_length", "distinct", "repeats", "distinct_pairs", "symbols", "punctuation", "loud", "upper",
         "digits", "lines", "symbol_words", "other_letters")


def features(raw, offsets):
    """(texts, features) of texts' bytes: rates and ratios that do not grow with the text."""
    n = len(offsets) - 1
    starts, ends, bounds = words(raw, offsets, SPACES)
    hashes = word_hashes(raw, starts, ends)
    count = np.diff(bounds).astype(float)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1).astype(float)

    def per_byte(table):
        hits = np.concatenate([[0], np.cumsum(table[raw])])
        return np.diff(hits[offsets]) / size

    def per_word(flags):
        hits = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(hits[bounds]) / some

    text = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    pairs = mix(hashes + np.concatenate([hashes[1:], hashes[:1]]) * np.uint64(3)) if len(hashes) else hashes
    last = np.zeros(len(hashes), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    order2 = np.lexsort((pairs, text))
    fresh2 = np.ones(len(pairs), bool)
    fresh2[1:] = (pairs[order2][1:] != pairs[order2][:-1]) | (text[order2][1:] != text[order2][:-1])
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~last[:-1]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])
    newline, high = np.zeros(256, bool), np.zeros(256, bool)
    newline[10], high[128:] = True, True
    return np.stack([
        np.log1p(count), per_word(ends - starts), per_word(fresh), per_word(same), per_word(fresh2), per_byte(SYMBOLS),
        per_byte(PUNCTUATION), per_byte(LOUD), per_byte(UPPER), per_byte(DIGITS), per_byte(newline),
        per_word(symbols[ends] > symbols[starts]), per_byte(high)], axis=1)


def _measure(batches):
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        for first, last in chunks(offsets):
            x = features(raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            keep = [batch.column(c).slice(first, last - first) for c in ("doc_id", "hash", "host", "path")]
            yield pa.RecordBatch.from_arrays([*keep, lists], ["doc_id", "hash", "host", "path", "x"])


class Classifier:
    """An additive model: each feature is a step function over quantile bins."""

    def __init__(self, edges, beta):
        self.edges, self.beta = edges, beta

    @classmethod
    def fit(cls, x, y):
        edges = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in x.T]
        made = cls(edges, None)
        made.beta = logistic(made.design(x), y, ridge=1.0)
        return made

    def design(self, x):
        parts = [np.ones((len(x), 1))]
        for column, edges in zip(x.T, self.edges):
            parts.append(np.eye(len(edges) + 1)[np.searchsorted(edges, column, "right")])
        return np.concatenate(parts, axis=1)

    def evidence(self, x):
        return self.design(x) @ self.beta


def _judge(classifier):
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            keep = [batch.column(c) for c in ("doc_id", "hash", "host", "path")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(classifier.evidence(x))], ["doc_id", "hash", "host", "path", "evidence"])
    return run


def _logit(p):
    return F.log(p / (1 - p))


def _strength(between, within):
    """Pseudo-counts of a prior, from the variance between groups and that of one document (method of moments)."""
    return 1e6 if between is None or between <= within * 1e-6 else min(1e6, max(1.0, within / between))


def site_posteriors(judged: DataFrame, clip=1e-4):
    """(paths, rate): for each (host, path) the posterior rate of good documents, and the global rate.

    Sums of the classifier's probabilities by path, then by host (map-side combined; a row for each path and host). The
    prior of hosts is the global rate, the prior of a path its host's posterior; how strong either is follows from how
    much hosts, and paths of a host, differ beyond chance. A site of few documents stays near its prior."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = stage(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good")))
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    n, good, groups, squares = hosts.agg(
        F.sum("host_n"), F.sum("host_good"), F.count("*"), F.sum(F.col("host_good") ** 2 / F.col("host_n"))).first()
    if not n:
        return None, 0.5
    rate = min(max(good / n, clip), 1 - clip)
    within = rate * (1 - rate)
    spread = lambda squares, base, groups, free: (
        None if groups <= free else max(0.0, squares - base - (groups - free) * within) / n)
    strong = _strength(spread(squares, rate * rate * n, groups, 1), within)
    hosts = hosts.withColumn("host_rate", (F.lit(strong * rate) + F.col("host_good")) / (F.lit(strong) + F.col("host_n")))
    m, squares2, = paths.agg(F.count("*"), F.sum(F.col("good") ** 2 / F.col("n"))).first()
    strong2 = _strength(spread(squares2, squares, m, groups), within)
    paths = paths.join(small(stage(hosts.select(F.col("host").alias("_host"), "host_rate"))), F.col("host").eqNullSafe(F.col("_host")))
    paths = paths.withColumn("rate", (F.lit(strong2) * F.col("host_rate") + F.col("good")) / (F.lit(strong2) + F.col("n")))
    clipped = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("rate")))
    return stage(paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "host_rate", clipped.alias("path_rate"))), rate


def classify_quality(docs: DataFrame, labels: DataFrame, host, path, id_col="doc_id", text_col="text", label_col="quality",
                     sample=SAMPLE, keep=KEEP) -> DataFrame:
    """doc_id, hash, evidence, host_rate, path_rate, score, keep of each row of ``docs``; ``host`` and ``path`` are
    column expressions of ``docs`` (a site, and a part of it).

    The classifier is fitted on at most ``sample`` labelled documents, the first by hash of the id (of rows that repeat an id, one). ``score`` is the
    posterior: the evidence of the text, with the path's posterior rate in place of the global one.

    Null or empty texts have the features of no words. A null host or path is a site of its own. Rows with a null id are
    scored; null labels and labels of unknown ids are left out, of repeated labels the smallest counts. Labels of one
    class only, or none, give evidence 0 and keep all. Repeated rows are scored alike. An empty table gives no rows."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.xxhash64(docs[text_col].cast("string")).alias("hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    base = f"doc_id {kind}, hash long, host string, path string"
    measured = stage(rows.select("doc_id", "hash", "host", "path", "text").mapInArrow(tidy(_measure), base + ", x array<float>"))
    known = columns(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(
        F.min("label").cast("int").alias("label"))
    drawn = stage(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    taught = measured.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).groupBy("doc_id", "label").agg(
        F.min("x").alias("x")).collect()  # of rows that repeat an id, one
    taught.sort()
    y = np.array([r.label for r in taught])
    if not len(y) or y.min() == y.max():
        judged = measured.drop("x").withColumn("evidence", F.lit(0.0))
    else:
        classifier = Classifier.fit(np.array([r.x for r in taught], float), y)
        judged = measured.mapInArrow(tidy(_judge(classifier)), base + ", evidence double")
    judged = stage(judged)
    paths, rate = site_posteriors(judged)
    if paths is None:
        paths = judged.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"))
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    logit = F.col("evidence") + _logit(F.col("path_rate")) - F.lit(float(np.log(rate / (1 - rate))))
    return judged.join(small(paths), same).withColumn("score", 1 / (1 + F.exp(-logit))).select(
        "doc_id", "hash", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host, path, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all its columns stay, whatever their names.

    Null and empty texts, null ids, ties and labels of one class or none are judged as ``classify_quality`` says; repeated
    rows go or stay together. An empty table gives no rows."""
    judged = classify_quality(docs, labels, host, path, id_col, text_col, **options)
    of, print_ = fresh(docs, "_id", "_hash")
    rejected = stage(judged.where("NOT keep").select(F.col("doc_id").alias(of), F.col("hash").alias(print_)).distinct())
    same = docs[id_col].eqNullSafe(rejected[of]) & (F.xxhash64(docs[text_col].cast("string")) == rejected[print_])
    return docs.join(small(rejected), same, "left_anti")
