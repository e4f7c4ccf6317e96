import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memsight.constants import COMPONENTS, FREQUENCIES
from memsight.operators import features, labels, rolling, windows
from memsight.operators.rolling import component_features
from memsight.plans.features import feature_table, generate_features
from memsight.session import stage, tasks
from memsight.sources.stores import read_features
from tests.helpers import cascade, clock, located, make_inventory, make_log, off

DAY = 86400


def synthetic(seed, n, months=(5, 6)):
    """A few crowded servers over two months, with repeats, nulls and bursts."""
    pick = random.Random(seed)
    rows = []
    while len(rows) < n:
        month = pick.choice(months)
        t = off(month, pick.choice([1, 2, 14, 28, 29]), pick.choice([0, 0, 3, 23]), pick.randrange(12) * 5 % 60, pick.randrange(60))
        row = None if pick.random() < .05 else pick.randrange(6)
        col = None if pick.random() < .05 else pick.randrange(4)
        base = (pick.choice([1, 1, 2]), pick.choice([0, 2, 3, 15]), pick.randrange(2), pick.randrange(2), row, col)
        for _ in range(pick.choice([1, 1, 1, 2, 5])):
            rows.append((*base, pick.choice([1, 2]), t))
            t += pick.choice([0, 30, 61, 400])
    return rows


def brute(rows, freq, month, min_errors):
    """(sid, rb) -> class counts, hard errors: every window's lookback listed."""
    start, end = off(month, 1), off(month + 1, 1)
    last = off(month - 1, 1) if month > 1 else start
    out = {}
    for sid in {r[0] for r in rows}:
        mine = [located(r) for r in rows if r[0] == sid and last <= r[7] < end]
        for k in range((end - start + freq - 1) // freq):
            left, rb = start + k * freq, start + (k + 1) * freq
            if not any(left <= r["t"] < rb for r in mine):
                continue
            seen = [r for r in mine if rb - 30 * DAY <= r["t"] < rb]
            recent = Counter(c for r, c in zip(seen, cascade(seen, min_errors)) if r["t"] >= rb - 300 and c)
            cells = {}
            for r in seen:
                cells.setdefault((r["socket"], r["channel"], r["dimm"], r["rank"], r["bank"], r["row"], r["col"]), []).append(r["t"])
            hard = sum(sum(left <= t < rb for t in ts) for ts in cells.values() if max(ts) - min(ts) > 43200)
            out[sid, rb] = ([recent[c] for c in COMPONENTS], hard)
    return out


@pytest.mark.parametrize("seed,n,freq,limit", [
    (1, 150, "5m", 4), (2, 400, "5m", 40), (3, 400, "30m", 12), (4, 300, "5d", 8), (5, 400, "1h", 1000), (6, 400, "1d", 25)])
def test_rolling_classes_and_hard_errors(spark, seed, n, freq, limit):
    rows = synthetic(seed, n)
    expected = brute(rows, FREQUENCIES[freq], 6, limit)
    cells = windows.cell_windows(make_log(spark, rows), FREQUENCIES[freq], [6])
    found = {(r["sid"], r["rb"]): [r[f"5min_{c}_error"] for c in COMPONENTS]
             for r in component_features(cells, FREQUENCIES[freq], min_errors=limit).collect()}
    assert found == {k: v[0] for k, v in expected.items()}
    hard = {(r["sid"], r["rb"]): r["5min_hard"] for r in features.counter_features(cells).collect()}
    assert hard == {k: v[1] for k, v in expected.items()}


def test_all_months_at_once_equal_one_by_one(spark):
    rows = synthetic(7, 300, (1, 2, 6, 7, 8))
    log = make_log(spark, rows)
    expected = {}
    for month in range(1, 9):
        for (sid, rb), value in brute(rows, 3600, month, 10).items():
            expected[month, sid, rb] = value[0]
    cells = windows.cell_windows(log, 3600, range(1, 9))
    found = {(r["month"], r["sid"], r["rb"]): [r[f"5min_{c}_error"] for c in COMPONENTS]
             for r in component_features(cells, 3600, min_errors=10).collect()}
    assert found == expected


def test_window_bounds(spark):
    start = off(6, 1)
    log = make_log(spark, [(1, 3, 0, 0, 1, 1, 1, start), (1, 3, 0, 0, 1, 1, 1, start + 299), (1, 3, 0, 0, 1, 1, 2, start + 300)])
    cells = windows.cell_windows(log, 300, [6])
    rows = {r["rb"]: r for r in features.counter_features(cells).collect()}
    assert set(rows) == {start + 300, start + 600}
    assert (rows[start + 300]["5min_counter"], rows[start + 300]["5min_mtbe"]) == (2, 299)
    assert (rows[start + 600]["5min_mtbe"], rows[start + 600]["5min_scrub"]) == (0, 1)


def test_statistics_ignore_rank_and_slot_and_missing_keys(spark):
    t = off(6, 1) + 10
    rows = [(1, 2, 0, 0, 1, 1, 1, t), (1, 3, 1, 0, 1, 1, 1, t), (1, 2, 0, 0, 2, 1, 1, t), (1, 2, 0, 0, None, 1, 1, t),
            (1, 14, 0, 0, 5, None, 1, t)]
    cells = windows.cell_windows(make_log(spark, rows), 300, [6])
    (r,) = features.statistical_features(cells).collect()
    assert (r["5min_socket_count"], r["5min_bank_count"], r["5min_row_count"], r["5min_col_count"], r["5min_cell_count"]) == (2, 2, 3, 1, 2)
    assert r["5min_row_mean"] == pytest.approx(4 / 3) and r["5min_row_median"] == 1
    assert r["5min_row_std"] == pytest.approx(statistics.stdev([2, 1, 1])) and r["5min_col_std"] == 0
    (s,) = features.statistical_features(cells, compat_swap=True).collect()
    assert (s["5min_row_median"], s["5min_row_std"]) == (pytest.approx(r["5min_row_std"]), r["5min_row_median"])


def test_one_hot(spark):
    inventory = make_inventory(spark, [(1, "A2", 16, "M3"), (2, "A1", 8, "M1"), (2, "B1", 8, "M1")])
    rows = spark.createDataFrame([(1,), (2,), (3,)], "sid long")
    out = {r["sid"]: r for r in features.with_one_hot(rows, inventory).collect()}
    assert (out[1]["model_A2"], out[1]["dimm_num_16"], out[1]["manufacturer_M3"]) == (1, 1, 1)
    assert (out[2]["model_A1"], out[2]["model_B1"]) == (1, 1)
    assert sum(out[3][c] for c in features.one_hot_columns()) == 0


def test_feature_table_and_store(spark, tmp_path):
    rows = synthetic(8, 200)
    log, inventory = make_log(spark, rows), make_inventory(spark, [(1, "A1", 8, "M1")])
    generate_features(log, inventory, str(tmp_path), ["1h", "5d"], [6], min_errors=10)
    table = read_features(spark, str(tmp_path), "1h", [6])
    active = windows.active_windows(log, 3600, [6])
    assert table.count() == active.count() > 0
    assert [len(features.feature_columns(g)) for g in (1, 2, 3, 4)] == [6, 19, 37, 52]
    assert set(features.feature_columns()) <= set(table.columns)
    for r in table.collect():
        assert r["predict_time"] == clock(r["t_predict"])
        assert r["5min_soft"] + r["5min_hard"] == r["5min_counter"] == r["5min_read"] + r["5min_scrub"]
    assert labels.select_features(table.selectExpr("*", "0 as class"), 1).columns[3:-1] == features.feature_columns(1)


def test_string_server_ids(spark):
    from pyspark.sql import functions as F

    log = make_log(spark, synthetic(9, 100)).withColumn("sid", F.concat(F.lit("srv-"), F.col("sid").cast("string")))
    inventory = make_inventory(spark, [(1, "A1", 8, "M1")]).withColumn("sid", F.concat(F.lit("srv-"), F.col("sid").cast("string")))
    table = feature_table(log, inventory, "1h", [6], 10, staged=False)
    assert table.filter("sid = 'srv-1' and model_A1 = 1").count() > 0


def test_last_window_of_a_step_without_a_name(spark):
    """Ten-day windows: the month's last one ends nine days after it, and the first day's errors have left it."""
    rows = [(1, 3, 0, 0, 5, c, 1, off(3, 1) + 60 * c) for c in range(30)] + [(1, 3, 0, 0, 5, 1, 1, off(3, 31))]
    freq = 10 * 86400
    cells = windows.cell_windows(make_log(spark, rows), freq, [3], recent=freq)
    last = component_features(cells, freq, min_errors=10).orderBy(F.desc("rb")).first()
    row = {k: v for k, v in last.asDict().items() if v and k not in ("sid", "month", "rb")}
    assert list(row.values()) == [1] and next(iter(row)).endswith("random_error")


def test_windows_that_the_grid_cannot_hold_are_refused(spark):
    log = make_log(spark, [(1, 3, 0, 0, 5, 1, 1, off(3, 1))])
    for options in ({"recent": 900}, {"lookback": 86400 + 1}):
        with pytest.raises(ValueError):
            windows.cell_windows(log, 300, [3], **options)


def test_shuffles_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """Partitions of the wide shuffles follow the counted rows, whatever adaptive execution makes of their bytes."""
    assert tasks(spark.range(1000), 10) == 100
    assert tasks(spark.range(1000), 10 ** 6) == spark.sparkContext.defaultParallelism
    rows = [(1 + i % 3, i % 5, 0, i % 4, i % 7, i % 11, 1 + i % 2, off(6, 1 + i % 9) + 60 * i) for i in range(400)]
    found = []
    for n in (2, 29):
        for module in (windows, rolling, features):
            monkeypatch.setattr(module, "tasks", lambda df, n=n: n)
        cells = stage(windows.cell_windows(make_log(spark, rows), 3600, [6]))
        tables = {"rolling": component_features(cells, 3600, min_errors=10), "counts": features.statistical_features(cells)}
        plans = {name: df._jdf.queryExecution().toString() for name, df in tables.items()}
        assert plans["rolling"].count(f", {n}), REPARTITION_BY_NUM") >= 4 and f", {n}), REPARTITION_BY_NUM" in plans["counts"]
        found.append({name: sorted(tuple(round(v, 9) for v in r) for r in df.collect()) for name, df in tables.items()})
    assert found[0] == found[1] and all(found[0].values())


def test_a_month_without_windows_has_no_lookback(spark):
    """A server's rows serve the month after theirs only if it has errors there; the features of the others are the same."""
    rows = [(1, 3, 0, 0, 5, c, 1, off(5, 20) + 60 * c) for c in range(20)] + [(1, 3, 0, 0, 5, 1, 1, off(6, 3) + 3500)]
    alone = [(2, 3, 0, 0, 5, c, 1, off(5, 20) + 60 * c) for c in range(20)]
    cells = windows.cell_windows(make_log(spark, rows + alone), 3600, [5, 6])
    assert {(r.sid, r.month) for r in cells.select("sid", "month").distinct().collect()} == {(1, 5), (1, 6), (2, 5)}
    found = {(r.sid, r.rb): r.asDict() for r in component_features(cells, 3600, min_errors=10).filter("month = 6").collect()}
    (key, values), = found.items()
    assert key[0] == 1 and sum(v for k, v in values.items() if k.startswith("5min_")) == 1


def test_servers_of_any_number_keep_their_lookback(spark, monkeypatch):
    """Broadcast or joined in parts, the months of the servers leave the same cells; so does a log with rows without a server."""
    log = make_log(spark, synthetic(11, 200) + [(None, 3, 0, 0, 5, 1, 1, off(5, 2)), (None, 3, 0, 0, 5, 1, 1, off(6, 2))])
    found = []
    for small in (True, False):
        monkeypatch.setattr(windows, "is_small", lambda *_, small=small: small)
        found.append(sorted(map(str, windows.cell_windows(log, 3600, [5, 6]).collect())))
    assert found[0] == found[1] and any("sid=None" in r for r in found[0])


def test_equal_counts_are_combined_before_the_median(spark):
    """Windows with many groups of few distinct counts, against plain statistics; no aggregation holds a window's counts."""
    rows = [(1, 3, 0, 0, r, c, 1, off(6, 2) + 10 * c) for r in range(9) for c in range(13) for _ in range(1 + (r * c) % 4)]
    table = features.statistical_features(windows.cell_windows(make_log(spark, rows), 86400, [6]))
    counts = sorted(Counter((r[4], r[5]) for r in rows).values())
    got = table.first()
    assert got["5min_cell_count"] == len(counts) and got["5min_cell_median"] == statistics.median(counts)
    assert got["5min_cell_mean"] == pytest.approx(statistics.mean(counts))
    assert got["5min_cell_std"] == pytest.approx(statistics.stdev(counts))
    assert "ObjectHashAggregate" not in table._jdf.queryExecution().executedPlan().toString()
