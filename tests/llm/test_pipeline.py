import hashlib
import re
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from llm.personal_data import base_spans, mask
from llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_stages_against_plain_counterparts(spark, tmp_path):
    """Each stage on what its predecessor kept, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF)
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs.collect(), (docs := spark.read.parquet(str(tmp_path / name))).collect())
    rows = {name: ({r.doc_id: r for r in a}, b) for name, (a, b) in seen.items()}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows["quality"]
    kept = {r.doc_id for r in after}
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in kept for i in good) > .97 * len(good)
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i not in kept for i in bad) > .7 * len(bad)

    before, after = rows["near_duplicates"]
    ids = {r.doc_id for r in after}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for i, r in before.items() if (w := WORD.findall(r.text.lower()))}
    linked = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    for i in before:
        group, todo = set(), [i]
        while todo:
            group.add(x := todo.pop())
            todo += [y for y in linked.get(x, ()) if y not in group]
        assert (i in ids) == (i == min(group))

    before, after = rows["personal_data"]
    assert len(after) == len(before)
    same = sum(r.text == mask(before[r.doc_id].text, base_spans(before[r.doc_id].text)) for r in after)
    assert same >= .98 * len(after) and all(r.n_chars == len(r.text) for r in after)
    assert not any(base_spans(r.text) for r in after)

    before, after = rows["source_mix"]
    size = Counter()
    for r in before.values():
        size[r.source] += len(WORD.findall(r.text))
    taken = Counter()
    for r in after:
        assert before[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] for s in taken)
    assert max(Counter(r.doc_id for r in after).values()) <= 2

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = Counter((r.doc_id, tuple(sp.encode(r.text, add_bos=True, add_eos=True))) for r in seen["tokens"][0])
    assert Counter((r.doc_id, tuple(r.ids)) for r in seen["tokens"][1]) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in seen["tokens"][1])

    again = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in again.collect()) == Counter((r.doc_id, r.ids_sha256) for r in seen["tokens"][1])


def test_stages_take_awkward_rows(spark):
    from awkward import AWKWARD, table

    for extra in (False, True):   # also columns whose names the stages use themselves
        docs = table(spark, AWKWARD, extra=extra)
        for empty in (False, True):
            rows = docs.where("false") if empty else docs
            for name, function in corpus_pipeline.STAGES:
                out = function(spark, rows, SF)
                if name != "tokens":
                    assert out.columns == docs.columns, name
                assert bool(out.collect()) != empty, name


def test_large_lists_of_rows_are_shuffled(spark, monkeypatch):
    """The stages give the same without broadcasts."""
    from awkward import AWKWARD, table

    from llm import common

    docs = table(spark, AWKWARD)
    found = [Counter(map(str, f(spark, docs, SF).collect())) for _, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(common, "estimated_bytes", lambda df: 1 << 40)
    assert [Counter(map(str, f(spark, docs, SF).collect())) for _, f in corpus_pipeline.STAGES] == found
