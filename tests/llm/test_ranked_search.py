import math
import random
from collections import Counter

import numpy as np
import pytest
from awkward import AWKWARD, table, texts
from llm import ranked_search as module
from llm.ranked_search import Best, ranked_search, search_slice, terms


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, doc_id string, score int")


def plain(docs, asked, k=20):
    """docs: (doc_id, text); every pair of an item and a document is scored."""
    held = [(i, Counter(t), len(t)) for i, x in docs if (t := terms(x))]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in asked:
        scored = []
        for doc, c, n in held:
            m = 75 + 25 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("cells", [module.CELLS, 300])
def test_equals_scoring_every_pair(spark, monkeypatch, cells):
    monkeypatch.setattr(module, "CELLS", cells)
    docs = list(enumerate(texts(400, 5))) + [(i, t) for i, t, _ in AWKWARD]
    asked = [(i, t) for i, t in enumerate(texts(30, 6, 12))] + [(90, "über ÉTÉ Été MIT mit mit 904 no_such"), (91, " ".join(f"w{i}" for i in range(200)) + " mit")]
    data = table(spark, [(i, t, "a") for i, t in docs])
    got = [tuple(r) for r in ranked_search(data, items(spark, asked)).collect()]
    assert Counter(got) == Counter(plain(docs, asked))
    assert ranked_search(data, items(spark, asked)).columns == ["item_id", "rank", "doc_id", "score"]
    # blocks of few items
    assert Counter(tuple(r) for r in ranked_search(data, items(spark, asked), block=7).collect()) == Counter(got)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words") for i in range(60, 0, -1)] + [(0, "others"), (None, "same words"), (70, "others"), (71, "others others")]
    got = ranked_search(table(spark, [(i, t, "a") for i, t in docs]), items(spark, [(1, "words")])).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(i, i) for i in range(1, 21)]
    few = ranked_search(table(spark, [(1, "a", "s"), (None, "a", "s"), (2, "b", "s")]), items(spark, [(1, "a")]))
    assert [r.doc_id for r in few.orderBy("rank").collect()] == [1, None]


def test_awkward_items_and_empty_tables(spark):
    data = table(spark, [(i, t, "a") for i, t in enumerate(texts(20, 7))])
    asked = items(spark, [(None, "the"), (1, None), (2, ""), (3, " .,"), (4, "zzz"), (5, "the"), (5, "of and")])
    got = ranked_search(data, asked).collect()
    assert {r.item_id for r in got} == {5}
    assert Counter(tuple(r) for r in got) == Counter(plain(list(enumerate(texts(20, 7))), [(5, "of and")]))
    assert ranked_search(data, asked.where("false")).count() == 0
    assert ranked_search(data.where("false"), asked).count() == 0


def test_masks_that_cannot_reach_the_best_are_not_scored():
    rng = random.Random(2)
    often = np.array([[rng.randint(0, 3) * (rng.random() < .4) for _ in range(70)] for _ in range(900)], np.int64)
    weights, m, doc = np.array([rng.randint(1, 9000) for _ in range(70)], np.int64), np.full(900, 100), np.arange(900)
    best, scored, add = Best(20), [], Best.add
    best.add = lambda s, d, n: (scored.extend(d), add(best, s, d, n))
    search_slice(best, np.arange(70), weights, often, m, doc, np.zeros(900, bool))
    want = sorted((-int((weights * module.gain(often[i], 100)).sum()), i) for i in range(900))[:20]
    assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc.tolist())] == want
    assert len(scored) == len(set(scored)) < 900
