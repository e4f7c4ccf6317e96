"""All findings of a measurement run, written as reports."""

from pyspark.sql import functions as F

from memsight.constants import FAILURE_TYPES, WINDOWS
from memsight.operators import measure, spatial
from memsight.operators.prepare import FACTORS
from memsight.session import stage, staging
from memsight.sources.stores import write_report


def findings(log, tickets, inventory, **thresholds) -> dict:
    """Report name -> DataFrame.

    The log is scanned twice: for the months in which servers have errors, and for the errors of failed servers, joined with
    their tickets and counted per cell and second. Both are staged; the leads of failed servers with their hardware, the
    component breakdown and the errors by server are staged aggregates of the second, and the reports are arithmetic on these."""
    inputs = (log, tickets, inventory)
    months = stage(measure.error_months(log, inventory))
    rows = stage(measure.second_counts(*inputs))
    leads = stage(measure.lead_times(*inputs, FACTORS, rows))
    parts = stage(spatial.component_breakdown(*inputs, rows=rows, **thresholds))
    counts = stage(measure.server_errors(*inputs, rows=rows))
    errors = counts.groupBy("failure_type").agg(F.sum("n_all").alias("n_errors"))
    predictable = measure.predictable_counts(*inputs, leads=leads)
    out = {
        "overall_distribution": measure.monthly_rates(*inputs, months_of=months),
        "overall_distribution_total": measure.overall_rates(*inputs, months_of=months),
        "predictable_analysis": measure.predictable_fraction(*inputs, leads=leads),
        "num_ce_analysis": measure.mean_errors(*inputs, counts=counts),
        "mtbe_analysis": measure.median_mtbe(*inputs, rows=rows),
        "component_breakdown": parts,
        "frac_failure_per_component_5m": spatial.failure_share(*inputs, predictable=predictable, parts=parts),
        "frac_ce_per_component_5m": spatial.error_share(*inputs, parts=parts),
        "failures_breakdown": spatial.error_breakdown(*inputs, errors=errors, parts=parts),
        "read_scrub_error_mean": measure.mean_read_scrub(*inputs, counts=counts),
        "hard_soft_error_mean": spatial.mean_hard_soft(*inputs, rows=rows),
    }
    for factor in FACTORS:
        out[f"{factor}_breakdown"] = measure.hardware_impact(*inputs, factor, leads=leads)
        out[f"{factor}_failure_rate"] = measure.failure_rate(*inputs, factor, leads=leads)
        out[f"{factor}_failure_numbers"] = measure.failure_numbers(*inputs, factor, leads=leads)
    return out


def write_findings(log, tickets, inventory, path, **thresholds):
    """One tab-separated file per finding, by failure type, with windows and names as published. What is staged for the
    run is removed at its end."""
    with staging(log.sparkSession):
        for name, report in findings(log, tickets, inventory, **thresholds).items():
            order = []
            if "failure_type" in report.columns:
                order.append("failure_type")
            if "window" in report.columns:
                order.append(F.array_position(F.array(*[F.lit(w) for w in WINDOWS]), F.col("window")))
            order += [c for c in ("component", "level", "month") if c in report.columns]
            if "failure_type" in report.columns:
                names = F.get(F.array(*[F.lit(n) for n in FAILURE_TYPES.values()]), F.col("failure_type").cast("int") - 1)
                report = report.orderBy(*order).withColumn("failure_type", F.coalesce(names, F.col("failure_type").cast("string")))
                order = []
            write_report(report, f"{path}/{name}", order)
