import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memsight.operators import spatial
from tests.helpers import cascade, located, make_inventory, make_log, make_tickets, off

FAIL = off(8, 20)


def run(spark, rows, min_errors=1000, tickets=None):
    log = make_log(spark, rows)
    servers = {r[0] for r in rows}
    inventory = make_inventory(spark, [(s, "A1", 8, "M1") for s in servers])
    tickets = make_tickets(spark, tickets or [(s, FAIL, 1) for s in servers])
    return log, tickets, inventory, min_errors


def classes(spark, rows, min_errors=1000, window="1m"):
    log, tickets, inventory, limit = run(spark, rows, min_errors)
    out = spatial.component_breakdown(log, tickets, inventory, {window: 60}, limit)
    return {r["component"]: r["n_ce"] for r in out.collect() if r["failure_type"] == 1 and r["n_ce"]}


def many(n, memory=lambda i: 3, rank=0, bank=0, row=lambda i: 1, col=lambda i: 1, sid=1):
    """n errors 1000 s apart."""
    return [(sid, memory(i), rank, bank, row(i), col(i), 1, off(1, 1) + 1000 * i) for i in range(n)]


def test_threshold_is_strict(spark):
    spread = dict(memory=lambda i: 0 if i % 2 else 2, row=lambda i: i, col=lambda i: i)
    assert classes(spark, many(1000, **spread)) == {"random": 1000}
    assert classes(spark, many(1001, **spread)) == {"socket": 1001}


def test_one_row_of_one_bank_is_no_coarse_fault(spark):
    assert classes(spark, many(1001)) == {"random": 1001}


def test_channel_bank_row_column(spark):
    assert classes(spark, many(50, memory=lambda i: i % 2, row=lambda i: i, col=lambda i: i), 40) == {"channel": 50}
    assert classes(spark, many(50, row=lambda i: i, col=lambda i: i), 40) == {"bank": 50}
    assert classes(spark, many(50, col=lambda i: i), 40) == {"row": 50}
    assert classes(spark, many(30, row=lambda i: i), 40) == {"column": 30}


def test_cell_gap(spark):
    pair = lambda gap, row: [(1, 3, 0, 0, row, row, 1, off(1, 1)), (1, 3, 0, 0, row, row, 1, off(1, 1) + gap)]
    assert classes(spark, pair(60, 1) + pair(61, 2)) == {"cell": 2, "random": 2}
    assert classes(spark, pair(0, 1)) == {"cell": 2}
    assert classes(spark, pair(60, 1)[:1]) == {"random": 1}


def test_rows_without_row_or_column(spark):
    rows = [
        (1, 3, 0, 0, None, 7, 1, off(1, 1)), (1, 3, 0, 0, None, 7, 1, off(1, 1) + 5),   # no row: neither cell nor random
        (1, 3, 0, 0, 4, None, 1, off(1, 2)),                                           # no column
        (1, 3, 0, 0, 5, 5, 1, off(1, 3)),
    ]
    assert classes(spark, rows) == {"random": 1}
    # a column fault takes the error without a row
    rows += [(1, 3, 0, 0, 8, 7, 1, off(1, 4)), (1, 3, 0, 0, 9, 7, 1, off(1, 4))]
    assert classes(spark, rows) == {"random": 1, "column": 4}
    # a row fault takes the error without a column
    rows += [(1, 3, 0, 0, 4, 1, 1, off(1, 5)), (1, 3, 0, 0, 4, 2, 1, off(1, 5))]
    assert classes(spark, rows) == {"random": 1, "column": 4, "row": 3}


def synthetic(seed, n, nulls=True):
    """Errors crowded into few slots, banks, rows and columns, so that every class appears."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        sid = pick.choice([1, 1, 2, 3])
        row = pick.choice([None, 1, 2, 3, 4, 5]) if nulls and pick.random() < .2 else pick.randrange(12)
        col = None if nulls and pick.random() < .1 else pick.randrange(8)
        rows.append((sid, pick.choice([0, 1, 2, 13, 14, 20]), pick.randrange(2), pick.randrange(3), row, col,
                     pick.choice([1, 2]), off(1, 1) + pick.randrange(200) * 40 + pick.choice([0, 10**6])))
    return rows


@pytest.mark.parametrize("seed,n,limit", [(1, 60, 4), (2, 200, 9), (3, 400, 30), (4, 400, 100)])
def test_against_the_sequential_cascade(spark, seed, n, limit):
    rows = synthetic(seed, n)
    expected = Counter()
    for sid in {r[0] for r in rows}:
        mine = [located(r) for r in rows if r[0] == sid]
        expected.update(c for c in cascade(mine, limit) if c)
    assert classes(spark, rows, limit) == dict(expected)


def test_faults_name_the_components(spark):
    rows = synthetic(5, 300)
    log, tickets, inventory, limit = run(spark, rows, 20)
    totals = spatial.component_breakdown(log, tickets, inventory, {"1m": 60}, limit)
    found = spatial.faults(log, tickets, inventory, min_errors=limit)
    assert {r[0]: r[1] for r in found.groupBy("component").agg(F.sum("n_errors")).collect()} == {
        r["component"]: r["n_ce"] for r in totals.collect() if r["failure_type"] == 1 and r["n_ce"]}
    assert found.filter("component = 'socket' and channelid is not null").count() == 0
    assert found.filter("component = 'cell' and (row_no is null or col_no is null)").count() == 0


def test_counts_never_grow_with_the_window(spark):
    log, tickets, inventory, limit = run(spark, synthetic(6, 300), 20, [(1, off(1, 3), 1), (2, off(1, 13), 2), (3, off(2, 20), 3)])
    out = spatial.component_breakdown(log, tickets, inventory, min_errors=limit)
    wide = out.groupBy("failure_type", "component").pivot("window").agg(F.first("n_ce")).collect()
    for r in wide:
        assert r["1m"] >= r["5m"] >= r["1h"] >= r["1d"] >= r["7d"] >= r["30d"]
