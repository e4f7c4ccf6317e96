"""Joins and slices that prepare the inputs."""

from pyspark.sql import DataFrame, functions as F

from memsight.functions.calendar import MONTH_START, RANGE_END
from memsight.operators.joins import join_counted, join_servers

FACTORS = ["DRAM_model", "DIMM_number", "server_manufacturer"]


def with_inventory(log: DataFrame, inventory: DataFrame) -> DataFrame:
    """Log rows with the hardware of their server; servers outside the inventory drop out."""
    return join_servers(log, inventory)


def ticketed_only(log: DataFrame, tickets: DataFrame) -> DataFrame:
    """Log rows of servers with any ticket, whatever its type."""
    return join_servers(log, tickets.select("sid").distinct(), "left_semi")


def typed(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.col("failure_type") > 0)


def with_tickets(log: DataFrame, tickets: DataFrame) -> DataFrame:
    """Log rows with each typed ticket of their server (rows multiply by tickets) and ``td``, the
    seconds from the error to the failure."""
    facts = typed(tickets).select("sid", "failed_time", "failed_off", "failure_type")
    return join_servers(log, facts).withColumn("td", F.col("failed_off") - F.col("t"))


def failure_rows(log: DataFrame, tickets: DataFrame, inventory: DataFrame, columns) -> DataFrame:
    """The joined log (errors x inventory x typed tickets) reduced to ``columns``.

    Columns: sid, failure_type, failed_off, td, ``n`` (how many log rows a row stands for), ``columns``.
    """
    facts = typed(tickets).select("sid", "failed_off", "failure_type")
    columns = list(dict.fromkeys([*columns, "t"]))
    joined = join_counted(log, [facts, inventory.select("sid")], columns)
    return joined.withColumn("td", F.col("failed_off") - F.col("t"))


def month_bounds(month: int):
    """(start of the lookback, start, end) of a month; month 1 has no lookback."""
    start = MONTH_START[month - 1]
    end = MONTH_START[month] if month < len(MONTH_START) else RANGE_END
    return (MONTH_START[month - 2] if month > 1 else start), start, end


def month_slice(log: DataFrame, month: int) -> DataFrame:
    """Rows of a month plus the previous month's rows of servers active in it."""
    last, start, end = month_bounds(month)
    t = F.col("t")
    if "month" in log.columns:   # an ingested log is partitioned by month
        log = log.filter(F.col("month").isin(sorted({max(month - 1, 1), month})))
    current = log.filter((t >= start) & (t < end))
    if last == start:
        return current
    before = log.filter((t >= last) & (t < start))
    active = current.select("sid").distinct()
    return current.unionByName(join_servers(before, active, "left_semi"))
