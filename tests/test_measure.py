import statistics

import pytest
from pyspark.sql import functions as F

from memsight.constants import PUBLISHED_FAILURES, PUBLISHED_LEVEL_SERVERS, PUBLISHED_MONTHLY_SERVERS
from memsight.operators import joins, measure, prepare, selection, spatial
from tests.helpers import make_inventory, make_log, make_tickets, off

FAIL = off(3, 10, 12)


def cell(sid, t, kind=1, memory=3, row=1, col=1):
    return (sid, memory, 0, 0, row, col, kind, t)


@pytest.fixture(scope="module")
def inputs(spark):
    log = make_log(spark, [
        cell(1, FAIL - 300), cell(1, FAIL - 301, 2), cell(1, FAIL + 50),      # exactly 5 min, above, after the failure
        cell(2, FAIL - 90000), cell(2, FAIL - 90000), cell(2, FAIL - 1000),
        cell(3, FAIL - 5000),                                                  # not in the inventory
        cell(4, FAIL - 60),                                                    # not predictable at 1m
        cell(5, FAIL - 99), cell(5, FAIL - 50000),                             # two tickets
    ])
    inventory = make_inventory(spark, [(1, "A1", 8, "M1"), (2, "A1", 8, "M2"), (4, "B1", 12, "M1"), (5, "C1", 24, "M4")])
    tickets = make_tickets(spark, [(1, FAIL, 1), (2, FAIL, 1), (3, FAIL, 1), (4, FAIL, 2), (5, FAIL, 3), (5, FAIL + 500, 3),
                                   (6, FAIL, 0)])
    return log, tickets, inventory


def by_window(df, kind, column):
    return {r["window"]: r[column] for r in df.filter(F.col("failure_type") == kind).collect()}


def test_windows_are_strict_and_the_denominator_counts_tickets(inputs):
    out = measure.predictable_fraction(*inputs)
    assert out.count() == 27
    first = by_window(out, 1, "n_sid")
    assert (first["1m"], first["5m"], first["10m"], first["1d"], first["7d"]) == (2, 2, 1, 1, 0)
    assert by_window(out, 1, "fraction")["5m"] == pytest.approx(2 / 3)
    assert by_window(out, 2, "n_sid")["1m"] == 0
    assert by_window(out, 3, "n_failures")["1m"] == 2


def test_published_denominators_can_be_supplied(spark, inputs):
    failures = measure.constant_by_type(spark, PUBLISHED_FAILURES)
    out = measure.predictable_fraction(*inputs, failures=failures)
    assert by_window(out, 1, "fraction")["5m"] == pytest.approx(2 / 567)
    rates = measure.monthly_rates(*inputs, population=PUBLISHED_MONTHLY_SERVERS).orderBy("month").collect()
    assert rates[2]["n_failure"] == 6 and rates[2]["failure_rate"] == pytest.approx(6 / 196497)
    numbers = measure.failure_numbers(*inputs, "DIMM_number", PUBLISHED_LEVEL_SERVERS["DIMM_number"])
    assert {r["level"]: r["population"] for r in numbers.collect()}["16"] == 7085


def test_means_are_over_servers_with_errors(inputs):
    out = measure.mean_errors(*inputs)
    assert by_window(out, 1, "mean_errors")["5m"] == pytest.approx((1 + 3) / 2)
    assert by_window(out, 1, "mean_errors")["10m"] == pytest.approx(3)
    assert by_window(out, 2, "mean_errors")["1m"] is None


def test_rows_multiply_by_tickets(inputs):
    # server 5: two errors seen from each of two tickets
    assert by_window(measure.mean_errors(*inputs), 3, "mean_errors")["1m"] == 4


def test_mtbe(inputs):
    out = measure.median_mtbe(*inputs)
    # server 2 at 5m: gaps 0 and 89000
    assert by_window(out, 1, "mtbe_minutes")["10m"] == pytest.approx(89000 / 2 / 60)
    assert by_window(out, 2, "mtbe_minutes")["1m"] is None


def test_read_and_scrub(inputs):
    out = measure.mean_read_scrub(*inputs)
    assert by_window(out, 1, "mean_scrub")["5m"] == 1
    assert by_window(out, 1, "servers_read")["5m"] == 1


def test_failure_numbers(inputs):
    rows = {r["level"]: r for r in measure.failure_numbers(*inputs, "DRAM_model").collect()}
    assert (rows["A1"]["n_failed"], rows["A1"]["n_unpredictable"]) == (2, 0)
    assert (rows["B1"]["n_failed"], rows["B1"]["n_unpredictable"]) == (1, 1)
    assert rows["C2"]["population"] == 0
    rates = {r["level"]: r["failure_rate"] for r in measure.failure_rate(*inputs, "DRAM_model").collect()}
    assert rates["A1"] == 100 and rates["C2"] is None


def test_untyped_tickets_only_count_as_failures(inputs):
    log, tickets, _ = inputs
    assert prepare.ticketed_only(log, tickets).select("sid").distinct().count() == 5
    assert prepare.with_tickets(log, tickets).filter("failure_type = 0").count() == 0


def test_hard_is_more_than_half_a_day(spark):
    log = make_log(spark, [cell(1, 10**6), cell(1, 10**6 + 43200), cell(1, 10**6, row=2), cell(1, 10**6 + 43201, row=2)])
    inventory, tickets = make_inventory(spark, [(1, "A1", 8, "M1")]), make_tickets(spark, [(1, off(3, 1), 1)])
    cells = spatial.hard_cells(log, tickets, inventory)
    assert {r["row_no"]: r["is_hard"] for r in cells.collect()} == {1: False, 2: True}


def test_month_slice_keeps_lookback_of_active_servers(spark):
    log = make_log(spark, [cell(1, off(5, 3)), cell(1, off(6, 2)), cell(2, off(5, 3)), cell(3, off(6, 3)), cell(1, off(4, 3))])
    assert sorted((r["sid"], r["t"]) for r in prepare.month_slice(log, 6).collect()) == [
        (1, off(5, 3)), (1, off(6, 2)), (3, off(6, 3))]
    assert prepare.month_slice(log, 1).count() == 0


def test_joins_of_large_tables_give_the_same(spark, inputs, monkeypatch):
    log, tickets, inventory = inputs
    runs = {
        "means": lambda: measure.mean_errors(*inputs), "mtbe": lambda: measure.median_mtbe(*inputs),
        "parts": lambda: spatial.component_breakdown(*inputs, min_errors=1),
        "inventory": lambda: prepare.with_inventory(log, inventory),
        "semi": lambda: prepare.ticketed_only(log, tickets), "slice": lambda: prepare.month_slice(log, 3),
    }
    small = {name: sorted(map(str, run().collect())) for name, run in runs.items()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert {name: sorted(map(str, run().collect())) for name, run in runs.items()} == small


def test_salted_join_splits_heavy_keys_only(spark):
    fact = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id")
    dim = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = joins.join_salted(fact, dim, ["k"], heavy_rows=100)
    plain = fact.join(dim, "k")
    assert sorted(out.collect()) == sorted(plain.collect())
    assert joins.join_salted(fact, dim, ["k"], "left_semi", 100).count() == plain.count()
    few = dim.filter("k = 1")
    assert joins.join_salted(fact, few, ["k"], "left", 100).filter("v is null").count() == 1000


@pytest.mark.parametrize("values", [[1.0], [1, 2], [5, 5, 5, 1], [2, 2, 3, 3], list(range(1000)), [0.25] * 999 + [9.0] * 1000])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 3.0), ("h", None)], "k string, v double")
    out = {r["k"]: r for r in selection.exact_median(df, ["k"], "v", n_cuts=7).collect()}
    assert out["g"]["median"] == statistics.median(values) and out["g"]["n"] == len(values)
    assert out["h"]["median"] == 3.0


def test_levels_outside_the_list_are_reported(spark):
    log = make_log(spark, [(s, 3, 0, 0, 1, 1, 1, off(3, 1)) for s in (1, 2)])
    inventory = make_inventory(spark, [(1, "D9", 8, "M1"), (2, None, 8, "M1")])
    tickets = make_tickets(spark, [(1, off(3, 9), 1), (2, off(3, 9), 1)])
    inputs = (log, tickets, inventory, "DRAM_model")
    rates = {r.level: (r.population, r.n_failed) for r in measure.failure_rate(*inputs).collect()}
    assert rates["D9"] == (1, 1) and rates["unknown"] == (1, 1) and rates["A1"] == (0, 0)
    numbers = {r.level: r.n_failed for r in measure.failure_numbers(*inputs).collect()}
    assert numbers["D9"] == 1 and set(numbers) == set(rates)
    impact = [r for r in measure.hardware_impact(*inputs).collect() if r.level == "D9" and r.window == "5m" and r.failure_type == 1]
    assert [(r.n_sid, r.fraction) for r in impact] == [(1, .5)]


def test_published_counts_can_be_passed(spark):
    """The fixed counts of the original fleet in place of those of the inputs."""
    from memsight import constants
    from memsight.operators import evaluate, measure, spatial

    log = make_log(spark, [(1, 3, 0, 0, r, 1, 1, off(3, 1) + 100 * r) for r in range(6)])
    inventory, tickets = make_inventory(spark, [(1, "A1", 8, "M1")]), make_tickets(spark, [(1, off(3, 9), 2)])
    inputs = log, tickets, inventory
    total = measure.overall_rates(*inputs, constants.PUBLISHED_MONTHLY_SERVERS, constants.PUBLISHED_TOTAL_SERVERS).first()
    assert total["overall_error_rate"] == 1 / constants.PUBLISHED_TOTAL_SERVERS
    errors = measure.constant_by_type(spark, constants.PUBLISHED_ERRORS, "n_errors")
    column = {(r["failure_type"], r["window"], r["component"]): r for r in spatial.error_breakdown(*inputs, errors=errors, min_errors=1000).collect()}
    assert column[2, "5m", "column"]["fraction"] == 6 / constants.PUBLISHED_ERRORS[2]
    rows = [(t, w, n) for t, own in constants.PUBLISHED_PREDICTABLE.items() for w, n in zip(constants.WINDOWS, own)]
    predictable = spark.createDataFrame(rows, "failure_type long, window string, n_sid long")
    shares = {(r["failure_type"], r["component"]): r["fraction"] for r in spatial.failure_share(*inputs, predictable=predictable).collect()}
    assert shares[2, "column"] == 1 / constants.PUBLISHED_PREDICTABLE[2][1]
    known = spark.createDataFrame([(t + 1, s, n) for s, own in constants.PUBLISHED_POSITIVES.items() for t, n in enumerate(own)],
                                  "failure_type int, split int, positives long")
    scored = spark.createDataFrame([(1, 2, s, 1, int(s < 40), .9 if s < 43 else .1) for s in range(1043)],
                                   "failure_type int, split int, sid long, t_predict long, class int, pred double")
    best = evaluate.best_threshold(scored, ["failure_type", "split"], known).first()
    assert best["tp"] == 40 and best["fn"] == constants.PUBLISHED_POSITIVES[2][0] - 40
