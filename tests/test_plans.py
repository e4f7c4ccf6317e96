from memsight.plans.measurement import write_findings
from tests.helpers import make_inventory, make_log, make_tickets, off


def lines(folder):
    (part,) = [p for p in folder.iterdir() if p.name.startswith("part")]
    return [line.split("\t") for line in part.read_text().splitlines()]


def test_findings_are_written_in_report_order(spark, tmp_path):
    log = make_log(spark, [(1, 3, 0, 0, r, 1, 1 + r % 2, off(3, 1) + 100 * r) for r in range(6)])
    inventory, tickets = make_inventory(spark, [(1, "A1", 8, "M1")]), make_tickets(spark, [(1, off(3, 9), 2)])
    write_findings(log, tickets, inventory, str(tmp_path), min_errors=3)
    assert len(list(tmp_path.iterdir())) == 20
    rows = lines(tmp_path / "predictable_analysis")
    assert rows[0] == ["failure_type", "window", "n_sid", "n_failures", "fraction"]
    assert [r[:2] for r in rows[1:4]] == [["ue", "1m"], ["ue", "5m"], ["ue", "10m"]]
    assert [r[2:] for r in rows if r[:2] == ["ce", "5m"]] == [["1", "1", "1.0"]]
    assert lines(tmp_path / "overall_distribution")[3][0] == "0001-03"
    assert len(lines(tmp_path / "component_breakdown")) == 1 + 3 * 9 * 7


def test_a_run_scans_the_log_twice(spark, tmp_path, monkeypatch):
    """Counted: the plans that are written, of staged tables and of reports, and the log's scans in them."""
    from memsight import session
    from memsight.operators import measure
    from memsight.plans import measurement
    from memsight.sources.tables import store_log

    log = store_log(make_log(spark, [(1, 3, 0, 0, r, 1, 1 + r % 2, off(3, 1) + 100 * r) for r in range(6)]), str(tmp_path / "log"))
    # small tables of known size, which are broadcast; heavy servers of larger ones are counted by another scan
    inventory, tickets = session.stage(make_inventory(spark, [(1, "A1", 8, "M1")])), session.stage(make_tickets(spark, [(1, off(3, 9), 2)]))
    scans = []

    def count(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans.append(plan.count(f"{tmp_path}/log"))

    def stage(df):
        count(df)
        return session.stage(df)

    monkeypatch.setattr(measurement, "stage", stage)
    for report in measurement.findings(log, tickets, inventory, min_errors=3).values():
        count(report)
    assert sum(scans) == 2 and len(scans) == 25
    count(measure.median_mtbe(log, tickets, inventory))
    assert scans[-1] >= 1   # the count sees a scan where there is one


def test_findings_of_a_run_equal_those_of_their_own(spark):
    import random

    from memsight.operators import measure, spatial
    from memsight.plans.measurement import findings

    pick = random.Random(2)
    log = make_log(spark, [(pick.randrange(9), pick.randrange(4), 0, pick.randrange(2), pick.choice([None, 1, 2, 3]), pick.choice([None, 1, 2]),
                            pick.choice([1, 2, 3]), off(pick.randrange(1, 5), pick.randrange(1, 20)) + pick.randrange(99)) for _ in range(700)])
    inventory = make_inventory(spark, [(s, pick.choice(["A1", "D9", None]), 8, "M1") for s in range(8)] + [(3, "B1", 12, "M2")])
    tickets = make_tickets(spark, [(s, off(4, 2 + s), pick.choice([0, 1, 2, 7])) for s in range(9)] + [(2, off(5, 9), 1)])
    inputs, limits = (log, tickets, inventory), {"min_errors": 20}
    run = findings(*inputs, **limits)
    alone = {"overall_distribution": measure.monthly_rates(*inputs), "overall_distribution_total": measure.overall_rates(*inputs),
             "predictable_analysis": measure.predictable_fraction(*inputs), "num_ce_analysis": measure.mean_errors(*inputs),
             "mtbe_analysis": measure.median_mtbe(*inputs), "component_breakdown": spatial.component_breakdown(*inputs, **limits),
             "read_scrub_error_mean": measure.mean_read_scrub(*inputs), "hard_soft_error_mean": spatial.mean_hard_soft(*inputs),
             "failures_breakdown": spatial.error_breakdown(*inputs, **limits),
             "DRAM_model_breakdown": measure.hardware_impact(*inputs, "DRAM_model")}
    for name, report in alone.items():
        rows = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*report.columns).collect())  # noqa: E731, B023
        assert rows(run[name]) == rows(report), name
