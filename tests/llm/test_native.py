import re
from collections import Counter, defaultdict

import pytest
import zlib

from llm.licenses import PHRASES, scan_licenses
from llm.mixing import mix, mixed_documents
from llm.sharding import shard_documents
from awkward import AWKWARD, table, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(n=150):
    return AWKWARD + [(i, t, f"s{i % 7}" if i % 3 else "s0") for i, t in enumerate(texts(n))]


def targets(sizes):
    """Water filling by plain repetition."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / w for s in open_})
            break
        out.update({s: 2.0 * sizes[s] for s in over})
        open_ -= over
    return out


def test_mix(spark):
    data = rows()
    got = mix(table(spark, data)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = mix(table(spark, data[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    empty = mix(table(spark, data).where("false"))
    assert empty.count() == 0


def test_mixed_documents(spark):
    data = rows(40)
    docs = table(spark, data)
    made = mixed_documents(docs)
    assert made.columns == docs.columns
    words = Counter()
    for r in made.collect():
        words[r.source] += len(WORD.findall(r.text))
    want = Counter()
    for r in mix(docs).collect():
        want[r.source] += r.taken
    assert +words == +want


def test_shards_are_even_and_groups_whole(spark):
    data = rows(300) + [(2000 + i, "a small group of equal texts", "z") for i in range(12)]
    got = shard_documents(table(spark, data), shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(load) == set(range(4))
    assert all(len(v) == 1 for v in homes.values())
    rest = sum(load.values()) - 15001
    assert max(load.values()) - min(load.values()) < 300 or max(load.values()) >= 15001 and rest / 3 < 15001
    assert shard_documents(table(spark, []), shards=4).count() == 0


def test_shards_split_a_group_that_is_too_large(spark):
    data = [(i, "the one text that has most of the rows", "z") for i in range(600)] + [(1000 + i, t, "a") for i, t in enumerate(texts(100))]
    got = shard_documents(table(spark, data), shards=8).collect()
    load, of = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        of[r.shard] += r.doc_id < 600
    assert max(load.values()) - min(load.values()) < 120
    assert len(got) == 700


def plain_scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and " \
             "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    data = rows() + [(3000, "x " + notice, "a"), (3001, "MIT License apache-license CC BY GNU general\npublic LICENSE", "a"),
                     (3002, "All rights reserved. All rights reserved.", "a"), (3003, "mit", "a"), (3004, "cc-by KGNU", "a")]
    got = scan_licenses(table(spark, data)).collect()
    want = Counter((i, *plain_scan(t)) for i, t, _ in data)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[3000].labels == "mit-notice" and 0.6 <= by[3000].score < 1
    assert len(by[3002].spans) == 2 and by[3001].labels == "apache,cc-by,gpl,mit" and by[3001].score == 1
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(table(spark, [])).count() == 0
