import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from awkward import AWKWARD, table, texts
from llm import toxicity
from llm.quality import classify_quality, keep_good
from llm.queries import model_path
from llm.sentencepiece_bpe import detokenize, tokenize
from llm.toxicity import forward_backward, score_toxicity


def odd_texts(n):
    rng = random.Random(6)
    parts = ["the", "ing", " ", "  ", "\n", "a", "er", "é", "ß", "日本", "😀", "1", "th", "on", "==", "▁", "the ", "...", "́", "\0", " " * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def test_tokens_equal_the_library(spark):
    rows = AWKWARD + [(2000 + i, t, "a") for i, t in enumerate(odd_texts(400) + texts(100) + [" " * 3000 + "x", "no" * 4000, "日" * 2000])]
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want, back = Counter(), Counter()
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        text = sp.decode(ids)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        back[i, text] += 1
    docs = table(spark, rows)
    got = tokenize(docs, model_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, detokenize(tokenize(docs, model_path()), model_path()).collect())) == back
    assert tokenize(table(spark, []), model_path()).count() == 0


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 3, 3, 140, 141, 205])
    e, moves = rng.normal(size=205) * 2, rng.normal(size=(2, 2))
    got, expected = forward_backward(e, bounds, moves)
    t, want, counts = np.exp(moves), np.zeros(205), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        step = [t * np.array([1, np.exp(x)]) for x in e[a:b]]
        for i in range(b - a):
            before, after = np.array([1.0, 0]), np.ones(2)
            for s in step[:i]:
                before = before @ s
                before /= before.sum()
            for s in step[:i:-1]:
                after = s @ after
                after /= after.sum()
            joint = before[:, None] * step[i] * after
            joint /= joint.sum()
            want[a + i] = joint[:, 1].sum()
            counts += joint
    assert np.allclose(got, want) and np.allclose(expected, counts)


def labelled(n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i, t in enumerate(texts(n, seed=9)):
        toxic = i % 6 == 0
        words = t.split(" ")
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["grumblefoo", "Nastybar!", "vilebaz,"]))
        rows.append((i, " ".join(words), f"s{i % 5}"))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxic_documents_and_spans(spark):
    rows, labels = labelled()
    truth = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(table(spark, rows + AWKWARD), truth).collect()
    assert len(got) == len(rows) + len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > .97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    words = [rows[i][1][s.start:s.end].lower() for i in range(0, 600, 6) for s in by[i].spans]
    assert len(words) > 100 and sum(any(w in x for w in ("grumblefoo", "nastybar", "vilebaz")) for x in words) > .95 * len(words)
    assert by[901].score == by[902].score < .5


def test_held_out_labels_do_not_teach(spark):
    rows, labels = labelled(200)
    only = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    docs = table(spark, rows)
    truth = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    assert len({r.score for r in score_toxicity(docs, truth(only)).collect()}) == 1
    flipped = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    one = sorted(score_toxicity(docs, truth(labels)).select("doc_id", "score").collect())
    assert one == sorted(score_toxicity(docs, truth(flipped)).select("doc_id", "score").collect())
    assert score_toxicity(docs.where("false"), truth(labels)).count() == 0


def junk(rows):
    return [(i, " ".join(f"{w}###" for w in t.split()) if i % 7 == 0 else t, s) for i, t, s in rows]


def test_quality(spark):
    rows = junk([(i, t + " and some more plain words here", f"s{i % 5}") for i, t in enumerate(texts(700, 11))])
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(0, 700, 2)] + [(None, 0, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = table(spark, rows + AWKWARD)
    site = (F.col("source"), F.concat_ws("/", "source", "lang"))
    got = classify_quality(docs, labels, *site).collect()
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    fresh = [r for r in got if r.doc_id is not None and r.doc_id < 700 and r.doc_id % 2]
    assert np.mean([r.keep == (r.doc_id % 7 != 0) for r in fresh]) > .98
    kept = keep_good(docs, labels, *site)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert classify_quality(docs.where("false"), labels, *site).count() == 0
    assert all(r.keep for r in classify_quality(docs, labels.where("false"), *site).collect())


def test_sparse_sites_stay_near_the_prior(spark):
    from llm.quality import site_posteriors

    rows = [("good", f"good/{i % 3}", 4.0) for i in range(300)] + [("bad", "bad/0", -4.0)] * 300 + [("new", "new/0", -4.0)]
    paths, rate = site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    by = {r._path: r.path_rate for r in paths.collect()}
    assert abs(rate - .5) < .05 and by["good/0"] > .9 and by["bad/0"] < .1
    assert by["bad/0"] < by["new/0"] < rate  # one document says less than three hundred


def test_logistic_shrinks_but_not_the_constant():
    x = np.ones((100, 1))
    assert toxicity.logistic(x, np.array([1.0] * 75 + [0.0] * 25))[0] == pytest.approx(np.log(3), abs=1e-3)
