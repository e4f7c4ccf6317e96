"""Fleet findings: error and failure rates, lead time, error counts, hardware factors."""

from pyspark.sql import DataFrame, functions as F

from memsight.constants import LEVELS, WINDOWS
from memsight.functions.calendar import month_key
from memsight.functions.topology import CELL
from memsight.operators.prepare import failure_rows, typed
from memsight.operators.reports import fill, other_types, per_window, scaffold, unpivot_windows
from memsight.operators.selection import exact_median

MONTHS = [f"0001-0{m}" for m in range(1, 9)]


def error_months(log: DataFrame, inventory: DataFrame) -> DataFrame:
    """(sid, month) of the inventory's servers with errors: at most nine rows a server, distinct before the join."""
    return log.select("sid", month_key(F.col("error_time")).alias("month")).distinct().join(inventory.select("sid"), "sid", "left_semi")


def monthly_rates(log: DataFrame, tickets: DataFrame, inventory: DataFrame, population=None, months_of=None) -> DataFrame:
    """Per month: servers with errors and with failures, and both as fractions of the population.

    Tickets count whatever their type. ``population``: the eight monthly populations; the default
    takes the whole inventory for each month. ``months_of``: ready rows of ``error_months``.
    """
    spark = log.sparkSession
    months_of = error_months(log, inventory) if months_of is None else months_of
    errors = months_of.groupBy("month").agg(F.count(F.lit(1)).alias("n_error"))
    failures = tickets.groupBy(month_key(F.col("failed_time")).alias("month")).agg(
        F.count_distinct("sid").alias("n_failure"))
    if population is None:
        servers = inventory.agg(F.count_distinct("sid").alias("population"))
        months = servers.select(F.explode(F.array(*[F.lit(m) for m in MONTHS])).alias("month"), "population")
    else:
        rows = [F.struct(F.lit(m).alias("month"), F.lit(p).cast("long").alias("population"))
                for m, p in zip(MONTHS, population)]
        months = spark.range(1).select(F.inline(F.array(*rows)))
    out = fill(errors, months, ["month"]).join(failures, "month", "left").fillna(0, ["n_error", "n_failure"])
    return out.withColumns({
        "error_rate": F.try_divide("n_error", "population"),
        "failure_rate": F.try_divide("n_failure", "population"),
    })


def overall_rates(log, tickets, inventory, population=None, total_servers=None, months_of=None) -> DataFrame:
    """One row: the monthly rates' means, and the fraction of servers with any error."""
    rates = monthly_rates(log, tickets, inventory, population, months_of).agg(
        F.avg("error_rate").alias("mean_error_rate"), F.avg("failure_rate").alias("mean_failure_rate"))
    if months_of is None:
        servers = log.select("sid").distinct().join(inventory.select("sid"), "sid", "left_semi")
    else:
        servers = months_of.select("sid").distinct()
    seen = servers.agg(F.count(F.lit(1)).alias("n_error"))
    if total_servers is None:
        total = inventory.agg(F.count_distinct("sid").alias("n_servers"))
    else:
        total = log.sparkSession.range(1).select(F.lit(total_servers).cast("long").alias("n_servers"))
    # three one-row results
    one = F.lit(1).alias("_one")
    out = rates.select("*", one).join(seen.select("*", one), "_one").join(total.select("*", one), "_one")
    return out.drop("_one").withColumn("overall_error_rate", F.try_divide("n_error", "n_servers"))


def second_counts(log: DataFrame, tickets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Errors (``n``) of failed servers per (failure_type, sid, failed_off, cell, error_type, second), with the lead ``td``: what all
    findings about failures aggregate. ``rows`` of the findings below takes it, staged, in place of a scan of the log."""
    columns = [*CELL, "error_type"]
    rows = failure_rows(log, tickets, inventory, columns)
    return rows.groupBy("failure_type", "sid", "failed_off", *columns, "t", "td").agg(F.sum("n").alias("n"))


def lead_times(log: DataFrame, tickets: DataFrame, inventory: DataFrame, columns=(), rows=None) -> DataFrame:
    """(failure_type, sid, ``columns`` of the inventory, max_td): the longest lead of each failed server.

    The longest lead comes from the first error, so the log is reduced to a row per server before
    any join. ``rows``: of ``second_counts``.
    """
    if rows is not None:
        longest = rows.groupBy("failure_type", "sid").agg(F.max("td").alias("max_td"))
        return longest.join(inventory.select("sid", *columns), "sid").groupBy("failure_type", "sid", *columns).agg(
            F.max("max_td").alias("max_td"))
    first = log.groupBy("sid").agg(F.min("t").alias("first_t"))
    facts = typed(tickets).select("sid", "failed_off", "failure_type")
    joined = first.join(facts, "sid").join(inventory.select("sid", *columns), "sid")
    return joined.groupBy("failure_type", "sid", *columns).agg(
        F.max(F.col("failed_off") - F.col("first_t")).alias("max_td"))


def failures_by_type(tickets: DataFrame) -> DataFrame:
    """Ticket rows per failure type."""
    return typed(tickets).groupBy("failure_type").agg(F.count(F.lit(1)).alias("n_failures"))


def constant_by_type(spark, values, name="n_failures") -> DataFrame:
    """A parameter table (failure_type, ``name``) from a dict, e.g. published counts."""
    rows = [F.struct(F.lit(t).cast("long").alias("failure_type"), F.lit(v).cast("long").alias(name))
            for t, v in values.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _over(name, seconds):
    return F.count_if(F.col("max_td") > seconds).alias(f"n_sid_{name}")


def predictable_counts(log, tickets, inventory, windows=WINDOWS, leads=None) -> DataFrame:
    """(failure_type, window, n_sid): failed servers with an error longer than the window before the failure.

    ``leads``: ready rows of ``lead_times``, also with hardware columns; a server may then have several."""
    if leads is None:
        leads = lead_times(log, tickets, inventory)
    else:
        leads = leads.groupBy("failure_type", "sid").agg(F.max("max_td").alias("max_td"))
    wide = leads.groupBy("failure_type").agg(
        *[_over(name, seconds) for name, seconds in windows.items()])
    rows = unpivot_windows(wide, ["failure_type"], ["n_sid"], windows)
    return fill(rows, scaffold(log.sparkSession, windows, other_types(tickets)), ["failure_type", "window"], ["n_sid"])


def predictable_fraction(log, tickets, inventory, windows=WINDOWS, failures=None, leads=None) -> DataFrame:
    """Predictable servers / ticket rows of the type (rows, as published, not servers)."""
    failures = failures_by_type(tickets) if failures is None else failures
    out = predictable_counts(log, tickets, inventory, windows, leads).join(F.broadcast(failures), "failure_type", "left")
    return out.withColumn("fraction", F.try_divide("n_sid", "n_failures"))


def _mean_positive(prefix, name):
    """Mean over the servers with at least one."""
    column = F.col(f"{prefix}_{name}")
    return [F.avg(F.when(column > 0, column)).alias(f"mean_{prefix}_{name}"),
            F.count_if(column > 0).alias(f"servers_{prefix}_{name}")]


def _server_means(per_server: DataFrame, tickets, prefixes, windows) -> DataFrame:
    wide = per_server.groupBy("failure_type").agg(
        *[agg for p in prefixes for name in windows for agg in _mean_positive(p, name)])
    names = [f"{kind}_{p}" for p in prefixes for kind in ("mean", "servers")]
    rows = unpivot_windows(wide, ["failure_type"], names, windows)
    return fill(rows, scaffold(per_server.sparkSession, windows, other_types(tickets)), ["failure_type", "window"],
                [n for n in names if n.startswith("servers")])


def server_errors(log, tickets, inventory, windows=WINDOWS, rows=None) -> DataFrame:
    """Per (failure_type, sid): all joined errors (``n_all``), and errors, read and scrub errors before each window. ``rows``: of
    ``second_counts``."""
    rows = failure_rows(log, tickets, inventory, ["error_type"]) if rows is None else rows
    n, kind = F.col("n"), F.col("error_type")
    return rows.groupBy("failure_type", "sid").agg(
        F.sum("n").alias("n_all"), *per_window(n, "errors", windows),
        *per_window(n, "read", windows, kind == 1), *per_window(n, "scrub", windows, kind == 2))


def mean_errors(log, tickets, inventory, windows=WINDOWS, counts=None) -> DataFrame:
    """Mean errors per failed server before each window, over servers with at least one.

    ``counts``: ready rows of ``server_errors``."""
    if counts is None:
        rows = failure_rows(log, tickets, inventory, [])
        counts = rows.groupBy("failure_type", "sid").agg(*per_window(F.col("n"), "errors", windows))
    return _server_means(counts, tickets, ["errors"], windows)


def mean_read_scrub(log, tickets, inventory, windows=WINDOWS, counts=None) -> DataFrame:
    """Mean read and mean scrub errors per failed server before each window."""
    counts = server_errors(log, tickets, inventory, windows) if counts is None else counts
    return _server_means(counts, tickets, ["read", "scrub"], windows)


def server_mtbe(log, tickets, inventory, windows=WINDOWS, rows=None) -> DataFrame:
    """(failure_type, sid, window, mtbe): mean gap in seconds between a server's consecutive errors.

    Gaps between ordered times add up to last - first, so no ordering is needed. Errors are paired
    within one ticket; a server with several tickets of a type pools their gaps. ``rows``: of ``second_counts``.
    """
    rows = failure_rows(log, tickets, inventory, []) if rows is None else rows
    td, n = F.col("td"), F.col("n")
    per_ticket = rows.groupBy("failure_type", "sid", "failed_off").agg(
        F.max("td").alias("max_td"),
        *per_window(n, "n", windows),
        *[F.min(F.when(td > s, td)).alias(f"min_{name}") for name, s in windows.items()])
    spans = [F.sum(F.col("max_td") - F.col(f"min_{w}")).alias(f"span_{w}") for w in windows]
    gaps = [F.sum(F.greatest(F.col(f"n_{w}") - 1, F.lit(0))).alias(f"gaps_{w}") for w in windows]
    per_server = per_ticket.groupBy("failure_type", "sid").agg(*spans, *gaps)
    long = unpivot_windows(per_server, ["failure_type", "sid"], ["span", "gaps"], windows)
    return long.filter(F.col("gaps") > 0).select(
        "failure_type", "sid", "window", (F.col("span") / F.col("gaps")).alias("mtbe"))


def median_mtbe(log, tickets, inventory, windows=WINDOWS, rows=None) -> DataFrame:
    """Median over failed servers of the mean time between errors, in minutes. ``rows``: of ``second_counts``."""
    medians = exact_median(server_mtbe(log, tickets, inventory, windows, rows), ["failure_type", "window"], "mtbe")
    rows = medians.select("failure_type", "window", F.col("n").alias("n_sid"),
                          (F.col("median") / 60).alias("mtbe_minutes"))
    return fill(rows, scaffold(log.sparkSession, windows, other_types(tickets)), ["failure_type", "window"], ["n_sid"])


UNKNOWN = "unknown"


def _level(factor):
    return F.coalesce(F.col(factor).cast("string"), F.lit(UNKNOWN))


def hardware_levels(inventory: DataFrame, factor: str) -> DataFrame:
    """(level): the listed levels and all others in the inventory; servers without a value are ``unknown``."""
    listed = inventory.sparkSession.range(1).select(F.explode(F.array(*[F.lit(str(v)) for v in LEVELS[factor]])).alias("level"))
    return listed.union(inventory.select(_level(factor).alias("level"))).distinct()


def level_population(inventory: DataFrame, factor: str, population=None) -> DataFrame:
    """(level, population): servers per level of a hardware factor, or supplied counts in the order of the listed levels."""
    spark = inventory.sparkSession
    if population is not None:
        rows = [F.struct(F.lit(str(v)).alias("level"), F.lit(p).cast("long").alias("population"))
                for v, p in zip(LEVELS[factor], population)]
        return spark.range(1).select(F.inline(F.array(*rows)))
    counts = inventory.groupBy(_level(factor).alias("level")).agg(F.count_distinct("sid").alias("population"))
    return fill(counts, hardware_levels(inventory, factor), ["level"], ["population"])


def _factor_leads(log, tickets, inventory, factor, leads):
    """Rows of ``lead_times`` with one factor; ``leads``: ready rows with all of them."""
    if leads is None:
        return lead_times(log, tickets, inventory, [factor])
    return leads.groupBy("failure_type", "sid", factor).agg(F.max("max_td").alias("max_td"))


def hardware_impact(log, tickets, inventory, factor, windows=WINDOWS, failures=None, leads=None) -> DataFrame:
    """Per (failure_type, window, level): predictable servers, and as a fraction of the type's failures."""
    failures = failures_by_type(tickets) if failures is None else failures
    leads = _factor_leads(log, tickets, inventory, factor, leads).withColumn("level", _level(factor))
    wide = leads.groupBy("failure_type", "level").agg(*[_over(name, s) for name, s in windows.items()])
    rows = unpivot_windows(wide, ["failure_type", "level"], ["n_sid"], windows)
    frame = scaffold(log.sparkSession, windows, other_types(tickets)).crossJoin(F.broadcast(hardware_levels(inventory, factor)))
    out = fill(rows, frame, ["failure_type", "window", "level"], ["n_sid"])
    out = out.join(F.broadcast(failures), "failure_type", "left")
    return out.withColumn("fraction", F.try_divide("n_sid", "n_failures"))


def _failed_servers(log, tickets, inventory, factor, leads):
    """One row per failed server in the joined log: its level and its longest lead over all tickets."""
    return _factor_leads(log, tickets, inventory, factor, leads).groupBy("sid").agg(
        F.min(_level(factor)).alias("level"), F.max("max_td").alias("max_td"))


def failure_rate(log, tickets, inventory, factor, population=None, leads=None) -> DataFrame:
    """Failed servers per level, in percent of the level's population."""
    failed = _failed_servers(log, tickets, inventory, factor, leads).groupBy("level").agg(
        F.count(F.lit(1)).alias("n_failed"))
    out = fill(failed, level_population(inventory, factor, population), ["level"], ["n_failed"])
    return out.withColumn("failure_rate", F.try_divide("n_failed", "population") * 100)


def failure_numbers(log, tickets, inventory, factor, population=None, window=WINDOWS["5m"], leads=None) -> DataFrame:
    """Per level: population, failed servers, and those without any error before the window."""
    failed = _failed_servers(log, tickets, inventory, factor, leads).groupBy("level").agg(
        F.count(F.lit(1)).alias("n_failed"),
        F.count_if(F.col("max_td") <= window).alias("n_unpredictable"))
    return fill(failed, level_population(inventory, factor, population), ["level"], ["n_failed", "n_unpredictable"])
