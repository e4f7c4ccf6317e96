"""Ranked lexical search: the best documents of each item, by masks of the terms that a document holds."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import columns, stage, tidy
from llm.oracles import LOWER as LOW, UPPER
from llm.textops import LOWER, NOT_ALPHANUMERIC, chunks, text_bytes, word_hashes, words

ITEMS = 512                 # items that are answered in one pass over the documents
CELLS = 1 << 21             # documents times terms that are held as a dense table
FEW = 64                    # documents that are scored together, at least
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans(UPPER, LOW)


def terms(text):
    """The terms of a text, as ``words`` finds them."""
    return [t.translate(TO_LOWER) for t in TERM.findall(text or "")]


def _hash(some):
    raw = "\n".join(some).encode()
    column = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(column, np.array([0, len(raw)]), NOT_ALPHANUMERIC)
    return word_hashes(column, starts, ends)


def _count(vocabulary):
    """Of each document with a term: id, number of terms, and number and frequency of those in ``vocabulary``, a sorted array of
    hashes."""
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for first, last in chunks(offsets):
                own, at = raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
                starts, ends, bounds = words(own, at, NOT_ALPHANUMERIC)
                n = np.diff(bounds)
                hashes = word_hashes(own, starts, ends)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(last - first), n)[hit]
                pair, often = np.unique(doc * max(len(vocabulary), 1) + place[hit], return_counts=True)
                doc, term = np.divmod(pair, max(len(vocabulary), 1))
                rows = np.flatnonzero(n)
                ends_at = np.searchsorted(doc, rows, "right").astype(np.int32)
                cuts = np.concatenate([[0], ends_at]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(first + rows)), pa.array(n[rows]),
                    pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(often))], ["doc_id", "n", "terms", "often"])
    return run


def _holders(size):
    """How many documents of a batch hold each term."""
    def run(batches):
        for batch in batches:
            held = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "df"])
    return run


def weight(documents, holders):
    """A term's weight, of the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def gain(often, m):
    """What a term adds for each unit of its weight; it rises with ``often`` and falls with ``m``."""
    return 1_000_000_000 * often // (1000 * often + 12 * m)


class Best:
    """The ``k`` best documents of an item so far, best first: high scores, then small ids, then those without id."""

    def __init__(self, k):
        self.k, self.score, self.doc, self.no_id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self):
        """A document with a lower score cannot be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, doc, no_id):
        good = score >= self.floor()
        score, doc, no_id = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.doc, doc), (self.no_id, no_id)))
        order = np.lexsort([doc, no_id, -score])[:self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]


def _groups(present):
    """Documents by presence mask: (an order of the documents, first position of each group in it). A mask is a bitmap of
    as many 64-bit words as it takes."""
    bits = np.packbits(present, axis=1)
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    wide[:, :bits.shape[1]] = bits
    masks = wide.view(np.uint64)
    order = np.lexsort(masks.T[::-1])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (masks[order[1:]] != masks[order[:-1]]).any(1)
    return order, np.flatnonzero(fresh)


def search_slice(best, columns, weights, often, m, doc, no_id):
    """Bring ``best`` up to date with a slice of documents. ``often``: documents x terms; ``columns``, ``weights``: the item's
    distinct terms and what a full gain of them is worth.

    Documents are grouped by the mask of the item's terms that they hold. A mask's highest possible score takes each of
    its terms at its highest frequency and the shortest document of the slice. Masks are scored by descending highest
    score, until the next one's is below the ``k``-th best score: then no document left can be among the best."""
    own = often[:, columns]
    present = own > 0
    some = np.flatnonzero(present.any(1))
    if not len(some):
        return
    most = weights * gain(own.max(0), m.min())
    # first without grouping: what no mask at all can reach
    some = some[present[some] @ most >= best.floor()]
    if not len(some):
        return
    order, start = _groups(present[some])
    order = some[order]
    highest = present[order[start]] @ most
    size = np.diff(start, append=len(order))
    by = np.argsort(-highest, kind="stable")
    taken = np.cumsum(size[by])
    at = 0
    while at < len(by) and highest[by[at]] >= best.floor():
        upto = int(np.searchsorted(taken, (taken[at - 1] if at else 0) + FEW)) + 1
        docs = np.concatenate([order[start[g]:start[g] + size[g]] for g in by[at:upto]])
        score = (weights * gain(own[docs], m[docs][:, None])).sum(1)
        best.add(score, doc[docs], no_id[docs])
        at = upto


def _search(items, size, documents, all_terms, k):
    """The ``k`` best documents of each item among a task's; items: (id, terms' numbers, weights times repeats)."""
    def run(batches):
        best = [Best(k) for _ in items]
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids = batch.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            cuts = batch.column("terms").offsets.to_numpy().astype(np.int64)
            term, often = batch.column("terms").values.to_numpy(), batch.column("often").values.to_numpy()
            m = 100 - 25 + 25 * n * documents // all_terms
            by = np.argsort(m, kind="stable")  # documents of like length have like bounds
            step = max(1, CELLS // max(size, 1))
            for first in range(0, len(by), step):
                rows = by[first:first + step]
                held = cuts[rows + 1] - cuts[rows]
                at = np.repeat(cuts[rows] - np.cumsum(held) + held, held) + np.arange(held.sum())
                dense = np.zeros((len(rows), size), np.int64)
                dense[np.repeat(np.arange(len(rows)), held), term[at]] = often[at]
                for b, (_, numbers, weights) in zip(best, items):
                    search_slice(b, numbers, weights, dense, m[rows], doc[rows], no_id[rows])
        for b, (item, _, _) in zip(best, items):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(b.score), item)), pa.array(b.doc, mask=b.no_id), pa.array(b.score)], ["item_id", "doc_id", "score"])
    return run


def _answer(documents: DataFrame, asked, k):
    """Rows (item_id, doc_id, score) that hold the ``k`` best documents of each of the items ``asked``: (id, terms)."""
    distinct = sorted({t for _, own in asked for t in own})
    hashes = _hash(distinct)
    order = np.argsort(hashes)
    vocabulary, number = hashes[order], {distinct[i]: n for n, i in enumerate(order.tolist())}
    held = stage(documents.mapInArrow(tidy(_count(vocabulary)), "doc_id long, n long, terms array<int>, often array<long>"))
    facts = held.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not facts.documents:
        return None
    found = held.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long")
    df = dict(found.groupBy("term").agg(F.sum("df").alias("df")).collect())
    items = []
    for item, own in asked:
        numbers, repeats = np.unique([number[t] for t in own], return_counts=True)
        weights = np.array([weight(facts.documents, df.get(i, 0)) for i in numbers.tolist()], np.int64) * repeats
        # a term that no document holds, or of weight 0, adds nothing
        some = (weights > 0) & np.array([i in df for i in numbers.tolist()])
        if some.any():
            items.append((item, numbers[some], weights[some]))
    return held.mapInArrow(_search(items, len(vocabulary), facts.documents, facts.terms, k), "item_id long, doc_id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, k=20, id_col="doc_id", text_col="text", item_col="item_id",
                  item_text_col="text", block=ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item, equal scores by ascending id.

    Terms are the runs of digits, letters and non-ASCII characters, A-Z lower-cased. Statistics are of all documents with
    a term. A term weighs floor(1000 ln((2 documents + 2) / (2 holders + 1))); a document's score sums, over the item's
    terms with repeats, the weight times 1e9 tf div (1000 tf + 12 m), where m is 75 + 25 n documents div all terms.

    1. One pass keeps of each document its length and the frequencies of the items' terms, staged. Terms are matched by
       64-bit hashes.
    2. Counts of documents, terms and holders come from that table; the driver sees a number for each of the items' terms.
    3. Each task goes through its documents in slices and groups them, for each item, by the mask of the item's terms that
       they hold (``search_slice``). What it keeps from slice to slice, ``k`` rows an item, makes most masks of later
       slices needless to score. No pair of an item and a document is written but these.
    4. The tasks' rows are merged, at first in parts of an item's rows.

    Items are asked in blocks of ``block``, each of which reads the documents once, so that what goes to tasks is bounded
    by a block's texts. Null and empty texts have no terms: such documents count nowhere, such items have no rows. Items
    without id ask nothing; of items that repeat an id the smallest text asks. Repeated documents are results of their
    own; those without id count and rank after others of equal score, with a null id. Empty tables give no rows. Further
    columns are not read."""
    spark = documents.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    texts = columns(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = columns(items, item_id=item_col, text=item_text_col).where("item_id IS NOT NULL AND text IS NOT NULL")
    asked = asked.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text")).orderBy("item_id")
    parts, held = [], []

    def answer():
        if held and (found := _answer(texts, list(held), k)) is not None:
            parts.append(found)
        held.clear()

    for row in asked.toLocalIterator():
        if own := terms(row.text):
            held.append((row.item_id, own))
        if len(held) == block:
            answer()
    answer()
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
    found = found.where(F.col("rank") <= k).drop("part", "rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(
        F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
