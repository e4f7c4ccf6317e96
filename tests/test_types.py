from memsight.operators import measure, spatial
from tests.helpers import make_inventory, make_log, make_tickets, off


def test_findings_have_rows_of_types_that_are_not_published(spark):
    log = make_log(spark, [(1, 3, 0, 0, r, 1, 1 + r % 2, off(3, 1) + 100 * r) for r in range(6)])
    inventory, tickets = make_inventory(spark, [(1, "A1", 8, "M1")]), make_tickets(spark, [(1, off(3, 9), 7)])
    args = log, tickets, inventory
    found = measure.predictable_fraction(*args).where("failure_type = 7 AND window = '5m'").collect()
    assert [(r.n_sid, r.fraction) for r in found] == [(1, 1.0)]
    for result in (measure.mean_read_scrub(*args), measure.median_mtbe(*args), measure.hardware_impact(*args, "DIMM_number"),
                   spatial.component_breakdown(*args, min_errors=3)):
        assert {r.failure_type for r in result.select("failure_type").distinct().collect()} == {1, 2, 3, 7}
