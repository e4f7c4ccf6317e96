import hashlib
import random
import re
from collections import Counter

from awkward import AWKWARD, table
from llm.personal_data import KINDS, base_spans, candidates, find_personal_data, redact

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or
                    kind == 2 and 14 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_equals_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "B.", "@", ".", "-", " ", "1", "22", "255", "256", "+", "4111111111111111", "x@y.zz", "+1 (555) 010-9999", "10.0.0.1", "é", "(", ")", "\n", "007"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_little_time():
    for run in ("a", "1", "a@", "1.", "+1 ", "+1", "1-", "@", "a.b"):
        base_spans(run * 100_000)


def spell(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_query_and_unseen_identifiers(spark):
    rows = AWKWARD + [(i, f"some words here, contact mailbox user{i}@mail{i}.example.com today please {i}", "a") for i in range(30)]
    rows += [(100, "contact mailbox someone@intranet today", "a"), (101, "other words 12345 and 1.2.3.4", "b"),
             (102, "card 4111 1111 1111 1111 or +44 20 7946 0958", None)]
    got = find_personal_data(table(spark, rows), min_seeds=5, least=0.4).collect()
    want = Counter()
    for i, t, _ in rows:
        spans = plain(t)
        want[i, *[sum(k == kind for _, k, _ in spans) for kind in range(4)], hashlib.sha256(spell(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[101].spans == "ip:22:29" and by[102].spans == spell(plain(rows[-1][1]))
    assert find_personal_data(table(spark, [])).count() == 0


def test_contexts_discover_what_the_patterns_miss(spark):
    """300 is no part of an address for the base, but it stands where twenty addresses stand."""
    rows = [(i, f"yesterday the server 10.0.0.{i} responded late", "a") for i in range(20)]
    rows += [(50, "yesterday the server 300.1.1.1 responded late", "a"), (51, "version 300.2.2.2 is out", "a"), (None, None, None)]
    docs = table(spark, rows)
    by = {r.doc_id: r for r in find_personal_data(docs).collect()}
    assert by[50].n_ip == 0 and by[50].spans == "ip:21:30" and by[51].spans == ""
    made = redact(docs)
    assert made.columns == docs.columns
    text = {r.doc_id: r.text for r in made.collect()}
    assert text[50] == text[3] == "yesterday the server <IP> responded late" and text[51] == rows[21][1] and text[None] is None


def test_contexts_discover_runs_of_several_words(spark):
    """A phone without a plus sign and a spaced card that fails the check digit are several words long."""
    rows = [(i, f"please call +1 (555) 010-99{i:02d} before noon", "a") for i in range(20)]
    rows += [(100 + i, f"paid with card 4111 1111 1111 {d:04d} last week", "a") for i, d in enumerate(
        d for d in range(1000, 1400) if luhn(f"411111111111{d}"))]
    rows += [(50, "please call (555) 010-7777 before noon", "b"), (51, "paid with card 4111 1111 1111 1112 last week", "b"),
             (52, "rows 12 13 14 15 of table 7", "b"), (53, "please call (555) 010-7777, before", "b"),
             (54, "please call 300.1.1.1 before noon", "b")]
    docs = table(spark, rows)
    by = {r.doc_id: r for r in find_personal_data(docs).collect()}
    assert by[50].n_phone == 0 and by[50].spans == "phone:12:26" and by[53].spans == "phone:12:26"
    assert by[51].n_card == 0 and by[51].spans == "card:15:34"
    assert by[52].spans == "" and by[54].spans == ""
    text = {r.doc_id: r.text for r in redact(docs).collect()}
    assert text[50] == text[3] == "please call <PHONE> before noon" and text[51] == "paid with card <CARD> last week"


def test_runs_have_no_length_cut():
    long = " ".join(["1234"] * 100)
    found = {text[s:e] for text in [f"number {long}, and 12 34"] for s, e, *_ in candidates(text, [])}
    assert found == {long}
    assert [(t[0], t[1]) for t in candidates("at (555) 010-7777) or", [])] == [(3, 17)]


def test_found_identifiers_make_further_patterns_heard(spark):
    """No seed stands at a gateway: only the addresses that were found at servers say what does. At a node, seeds are few."""
    rows = [(i, f"the server 10.0.0.{i} responded late", "a") for i in range(60)]
    rows += [(100 + i, f"server 300.1.1.{i} responded, then gateway 300.1.1.{i} stopped", "a") for i in range(6)]
    rows += [(200, "then gateway 301.1.1.1 broke", "b"), (201, "my bridge 302.1.1.1 broke", "b")]
    rows += [(300 + i, f"some node 10.1.0.{i} {i}x", "b") for i in range(6)] + [(400 + i, f"a{i} node 400.1.1.{i} y{i}", "b") for i in range(4)]
    by = {r.doc_id: r.spans for r in find_personal_data(table(spark, rows)).collect()}
    assert by[200] == "ip:13:22" and by[201] == ""
    assert all(by[400 + i] == "" for i in range(4))  # 6 of 10 are too few for the pattern
