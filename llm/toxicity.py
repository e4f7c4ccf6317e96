"""Toxic spans by a linear-chain conditional random field of two states, and document scores from its marginals."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import columns, stage, tidy
from llm.textops import NOT_ALPHANUMERIC, chunks, text_bytes, word_hashes, words

SAMPLE = 8000      # labelled documents that the model is fitted on (on the driver)
SAMPLE_BYTES = 1 << 26  # of their texts together
CHAIN_DOCS = 3000  # of these, documents of the field itself
SEGMENT = 64       # tokens that the two-level scan takes in a row
SLICE = 1 << 17    # tokens that are scanned together
STEPS = 40


def _segments(bounds):
    """Token positions in rows of SEGMENT, each text from a new row: (index or -1, first row of each text)."""
    counts = np.diff(bounds)
    rows = -(-counts // SEGMENT)
    first = np.concatenate([[0], np.cumsum(rows)])
    index = np.full(first[-1] * SEGMENT, -1, np.int64)
    at = np.repeat(first[:-1] * SEGMENT - bounds[:-1], counts) + np.arange(bounds[-1])
    index[at] = np.arange(bounds[-1])
    return index.reshape(-1, SEGMENT), first


def forward_backward(emission, bounds, moves):
    """Marginals of state 1 for each token, and the expected number of transitions (2, 2), in slices of about SLICE tokens, at
    least one text each.

    ``emission`` is the log-odds of state 1 at a token, ``moves`` the log-weights of transitions; a text starts from
    state 0."""
    parts, expected = [np.zeros(0)], np.zeros((2, 2))
    for first, last in chunks(bounds, SLICE):
        low, high = bounds[first], bounds[last]
        marginal, moved = _scan(emission[low:high], bounds[first:last + 1] - low, moves)
        parts.append(marginal)
        expected += moved
    return np.concatenate(parts), expected


def _scan(emission, bounds, moves):
    """Each row of SEGMENT tokens becomes one 2x2 matrix, texts are scanned over their rows, and then all rows
    at once: a long text takes no more steps than rows plus tokens of a row."""
    index, first = _segments(bounds)
    n = len(index)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    pad = (index < 0).T.copy()
    w = np.exp(np.clip(emission, -30, 30))[np.maximum(index, 0)].T.copy()
    (t00, t01), (t10, t11) = np.exp(moves)
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for s in range(SEGMENT):
        q00, q01 = p00 * t00 + p01 * t10, (p00 * t01 + p01 * t11) * w[s]
        q10, q11 = p10 * t00 + p11 * t10, (p10 * t01 + p11 * t11) * w[s]
        scale = 1 / (q00 + q01 + q10 + q11)
        if pad[s].any():
            scale[pad[s]] = 1
            q00, q01, q10, q11 = (np.where(pad[s], p, q) for p, q in ((p00, q00), (p01, q01), (p10, q10), (p11, q11)))
        p00, p01, p10, p11 = q00 * scale, q01 * scale, q10 * scale, q11 * scale
    start, end = np.zeros((2, n)), np.ones((2, n))
    rows = np.diff(first)
    for k in range(rows.max()):
        at = first[:-1][rows > k] + k
        if k == 0:
            start[0, at] = 1
            continue
        x = at - 1
        a0, a1 = start[0, x] * p00[x] + start[1, x] * p10[x], start[0, x] * p01[x] + start[1, x] * p11[x]
        start[:, at] = a0 / (a0 + a1), a1 / (a0 + a1)
        back = first[1:][rows > k] - 1 - k
        x = back + 1
        b0, b1 = p00[x] * end[0, x] + p01[x] * end[1, x], p10[x] * end[0, x] + p11[x] * end[1, x]
        end[:, back] = b0 / (b0 + b1), b1 / (b0 + b1)
    before = np.empty((SEGMENT, 2, n))
    a0, a1 = start
    for s in range(SEGMENT):
        before[s] = a0, a1
        a0, a1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * w[s]
        scale = 1 / (a0 + a1)
        a0, a1 = a0 * scale, a1 * scale
    expected, marginal = np.zeros((2, 2)), np.zeros((SEGMENT, n))
    b0, b1 = end
    for s in range(SEGMENT - 1, -1, -1):
        a0, a1 = before[s]
        b1w = b1 * w[s]
        j00, j01, j10, j11 = a0 * t00 * b0, a0 * t01 * b1w, a1 * t10 * b0, a1 * t11 * b1w
        scale = np.where(pad[s], 0, 1 / (j00 + j01 + j10 + j11))
        marginal[s] = (j01 + j11) * scale
        expected += [[j00 @ scale, j01 @ scale], [j10 @ scale, j11 @ scale]]
        f0, f1 = t00 * b0 + t01 * b1w, t10 * b0 + t11 * b1w
        norm = 1 / (f0 + f1)
        b0, b1 = np.where(pad[s], b0, f0 * norm), np.where(pad[s], b1, f1 * norm)
    out = np.empty(bounds[-1])
    inside = index >= 0
    out[index[inside]] = marginal.T[inside]
    return out, expected


class Tagger:
    """Known words (sorted hashes), their weights, the weight of unknown words, and transitions."""

    def __init__(self, known, weights, other, moves, scale):
        self.known, self.weights, self.other, self.moves, self.scale = known, weights, other, moves, scale

    def emission(self, hashes):
        if not len(self.known):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.weights[at], self.other)

    def marginals(self, hashes, bounds):
        return forward_backward(self.emission(hashes), bounds, self.moves)[0]

    def score(self, marginals, bounds):
        z = features(marginals, bounds) @ self.scale
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(marginals, bounds):
    """Of each text: 1, log of the expected number of toxic tokens, the largest marginal."""
    n = len(bounds) - 1
    total, most = np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        total[some] = np.add.reduceat(marginals, bounds[some])
        most[some] = np.maximum.reduceat(marginals, bounds[some])
    return np.stack([np.ones(n), np.log(total + 1e-3), most], axis=1)


def logistic(x, y, ridge=1.0, steps=30):
    """Weights of a logistic regression by Newton's method; the first column is the constant and is not shrunk."""
    beta, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * beta)
        beta += np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    return beta


def fit(texts, toxic):
    """texts: arrays of word hashes; toxic: 0 or 1 of each. The first half gives token labels and the field, the second
    half the scores' scale, so that chance finds of the first are not trusted.

    A token is labelled toxic if its document is and its word is found in more toxic documents than chance explains (a
    bound on the binomial tail, below 0.05 for all words together)."""
    toxic = np.asarray(toxic)
    half = np.arange(len(texts)) % 2 == 0
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    flat = np.array([np.log(rate / (1 - rate)), 0, 0])
    clean = np.array([flat[0] or -1e-6, 0, 0])  # no labels, or as many of each, say of no text that it is toxic
    bare = Tagger(np.zeros(0, np.uint64), np.zeros(0), -20.0, np.zeros((2, 2)), clean)
    if not toxic[half].any() or toxic[half].all():
        return bare
    own = [np.unique(texts[i]) for i in np.flatnonzero(half)]
    which = np.repeat(toxic[half], [len(w) for w in own])
    known, index = np.unique(np.concatenate(own), return_inverse=True)
    n1, n0 = np.bincount(index[which == 1], minlength=len(known)), np.bincount(index[which == 0], minlength=len(known))
    often, base = n1 + n0 >= 3, toxic[half].mean()
    n = np.maximum(n1 + n0, 1)
    share = np.clip(n1 / n, 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    marks = known[often & (n1 > 2 * base * n) & (surprise > np.log(often.sum() / 0.05))]
    if not len(marks):
        return bare
    known = known[often]
    ones, zeros = np.flatnonzero(half & (toxic == 1)), np.flatnonzero(half & (toxic == 0))
    ones = ones[:CHAIN_DOCS // 2]
    chain = np.sort(np.concatenate([ones, zeros[:CHAIN_DOCS - len(ones)]]))
    hashes = np.concatenate([texts[i] for i in chain])
    bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chain])])
    label = np.isin(hashes, marks) & np.repeat(toxic[chain] == 1, np.diff(bounds))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    column = np.where(known[at] == hashes, at, len(known))
    previous = np.concatenate([[False], label[:-1]])
    previous[bounds[:-1][bounds[:-1] < len(label)]] = False
    seen = np.bincount(2 * previous + label, minlength=4).reshape(2, 2)
    weights, moves = np.full(len(known) + 1, -2.0), np.zeros((2, 2))
    velocity = [np.zeros_like(weights), np.zeros_like(moves)]
    memory = [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, STEPS + 1):
        marginal, expected = forward_backward(weights[column], bounds, moves)
        slope = [np.bincount(column, label - marginal, len(weights)) - 0.05 * weights, (seen - expected) / len(chain) - 0.01 * moves]
        slope[1][0, 0] = 0  # only ratios matter
        for i, x in enumerate((weights, moves)):
            velocity[i] = 0.8 * velocity[i] + 0.2 * slope[i]
            memory[i] = 0.95 * memory[i] + 0.05 * slope[i] ** 2
            x += 0.5 * (velocity[i] / (1 - 0.8 ** step)) / (np.sqrt(memory[i] / (1 - 0.95 ** step)) + 1e-6)
    tagger = Tagger(known, weights[:-1], weights[-1], moves, flat)
    rest = np.flatnonzero(~half)
    if len(rest) and 0 < toxic[rest].sum() < len(rest):
        bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rest])])
        marginal = tagger.marginals(np.concatenate([texts[i] for i in rest]), bounds)
        tagger.scale = logistic(features(marginal, bounds), toxic[rest])
        tagger.scale[1:] = np.maximum(tagger.scale[1:], 0)  # more toxic tokens never make a text less toxic
    return tagger


def _hashes(batches):
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        for first, last in chunks(offsets):
            own, at = raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            starts, ends, bounds = words(own, at, NOT_ALPHANUMERIC)
            data = word_hashes(own, starts, ends).tobytes()
            texts = [data[8 * bounds[i]:8 * bounds[i + 1]] for i in range(last - first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), batch.column("label").slice(first, last - first),
                 pa.array(texts, pa.binary())], ["doc_id", "label", "hashes"])


def _tag(tagger):
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            for first, last in chunks(offsets):
                own, at = raw[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
                starts, ends, bounds = words(own, at, NOT_ALPHANUMERIC)
                marginal = tagger.marginals(word_hashes(own, starts, ends), bounds)
                score = tagger.score(marginal, bounds)
                place = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before a byte
                hit = np.flatnonzero(marginal >= 0.5)
                doc = np.searchsorted(bounds, hit, "right") - 1
                fresh = np.ones(len(hit), bool)
                fresh[1:] = (np.diff(hit) != 1) | (np.diff(doc) != 0)
                heads = np.flatnonzero(fresh)
                tails = np.concatenate([heads[1:], [len(hit)]]) - 1
                spans = [[] for _ in range(last - first)]
                for h, e in zip(heads.tolist(), tails.tolist()):
                    i, base = doc[h], place[at[doc[h]]]
                    spans[i].append({"start": int(place[starts[hit[h]]] - base), "end": int(place[ends[hit[e]]] - base),
                                     "marginal": float(marginal[hit[h]:hit[e] + 1].max())})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("held_out").slice(first, last - first),
                     pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))],
                    ["doc_id", "held_out", "score", "predicted", "spans"])
    return run


def held_out(doc_id, folds=5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample=SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of each row of ``docs``.

    The model is fitted on at most ``sample`` labelled rows (the first by hash of the id; of these, the shortest as far as their texts stay
    within ``SAMPLE_BYTES`` together; of rows that repeat an id, one) that are not held out: ids
    whose crc32 modulo 5 is 0 never teach. Spans are runs of tokens with a marginal of at least 0.5, as code points.
    Only the words of a text count for its score.

    A null or empty text has no tokens and gets the score of none. Rows with a null id are scored, never learned from;
    null labels and labels of unknown ids are left out, of repeated labels the largest counts. Without any toxic label
    all scores are the smoothed base rate; without labels they are just below 0.5. Repeated rows are scored alike; an empty table gives no rows."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    known = columns(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(
        F.max("label").cast("int").alias("label"))
    drawn = known.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample)
    kind = rows.schema["doc_id"].dataType.simpleString()
    drawn = F.broadcast(stage(drawn))
    sizes = rows.join(drawn, rows.doc_id == F.col("id")).groupBy("id", "label").agg(
        F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))  # a row for each drawn id
    first = Window.orderBy("bytes", F.xxhash64("id"), "id")  # a text that does not fit leaves out longer ones only
    chosen = stage(sizes.withColumn("sum", F.sum("bytes").over(first)).where(F.col("sum") <= SAMPLE_BYTES).select("id", "label"))
    taught = rows.join(F.broadcast(chosen), rows.doc_id == F.col("id")).select("doc_id", "label", "text").mapInArrow(
        tidy(_hashes), f"doc_id {kind}, label int, hashes binary").groupBy("doc_id", "label").agg(F.min("hashes").alias("hashes"))
    taught = sorted((r.doc_id, bytes(r.hashes), r.label) for r in taught.collect())
    taught = [taught[i] for i in np.random.default_rng(1).permutation(len(taught))]
    tagger = fit([np.frombuffer(h, np.uint64) for _, h, _ in taught], [y for _, _, y in taught])
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"
    return rows.withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "text").mapInArrow(tidy(_tag(tagger)), schema)
