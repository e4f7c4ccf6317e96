"""Spatial error classes over whole logs, and hard and soft cells.

The classes are defined as a cascade: socket faults are taken out first, then channels, banks, rows
and columns; cells and random errors remain. A class always takes out whole groups, so a group that
survives to a level has lost none of its own rows, and every level can be decided from the bottom up:

* errors are counted per cell and second, which also bounds what one cell can weigh (seconds of
  the calendar),
* each aggregation hands its sums, its distinct tests (min <> max) and the classes decided so far
  to the next coarser level,
* the coarsest flag that applies overrides what was decided below it.

No step joins flags back to rows, and every group is combined before it is shuffled.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.constants import CELL_GAP, COMPONENTS, HARD_SPAN, MIN_ERRORS, WINDOWS
from memsight.functions.topology import BANK, CELL, channelid, dimmid, socketid
from memsight.operators.measure import _server_means, predictable_counts
from memsight.operators.prepare import failure_rows
from memsight.operators.reports import fill, other_types, per_window, scaffold, unpivot_windows

SERVER = ["failure_type", "sid"]
COARSE = COMPONENTS[:3]


def _sums(prefix, windows, source=None, when=None):
    source = source or prefix
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c).otherwise(0))
    return [F.sum(pick(F.col(f"{source}_{w}"))).alias(f"{prefix}_{w}") for w in windows]


def _cell_gaps(log, tickets, inventory, rows=None) -> DataFrame:
    """Errors per (ticket, cell, second) with the gap to the cell's previous error, 0 for repeats."""
    ticket_cell = [*SERVER, "failed_off", *CELL]
    rows = failure_rows(log, tickets, inventory, CELL) if rows is None else rows
    seconds = rows.groupBy(*ticket_cell, "t", "td").agg(F.sum("n").alias("n"))
    previous = F.lag("t").over(W.partitionBy(*ticket_cell).orderBy("t"))
    return seconds.withColumn("gap", F.when(F.col("n") > 1, 0).otherwise(F.col("t") - previous))


def fine_classes(log, tickets, inventory, windows=WINDOWS, cell_gap=CELL_GAP, rows=None) -> DataFrame:
    """Row, column, cell and random groups, as if no bank or coarser group were faulty.

    A row of the result is a faulty row (``row_no``), a column group (``col_no``) or a single cell.
    ``all_*`` are its errors before each window, ``own_*`` those that take its class: an error
    without a row or column number follows the faulty groups it belongs to but is no cell.
    """
    gaps = _cell_gaps(log, tickets, inventory, rows)
    has_row, has_col = F.col("row_no").isNotNull(), F.col("col_no").isNotNull()

    # rows: more than one column is a row fault; without a row number every column stays apart
    rows = gaps.groupBy(*SERVER, *BANK, "row_no", F.when(~has_row, F.col("col_no")).alias("loose_col")).agg(
        F.sum("n").alias("n"),
        F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"),
        F.min(F.when(has_col, F.col("gap"))).alias("gap"),
        *per_window(F.col("n"), "all", windows), *per_window(F.col("n"), "col", windows, has_col))

    # other rows have one column at most: group them by it; more than one row is a column fault
    faulty = F.coalesce(F.col("first_col") != F.col("last_col"), F.lit(False))
    rows = rows.withColumns({
        "is_row": faulty,
        "line": F.when(faulty, F.col("row_no")).otherwise(F.col("first_col")),
    })
    groups = rows.groupBy(*SERVER, *BANK, "is_row", "line").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_row, F.col("n")).otherwise(0)).alias("n_rows"),
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
        F.min(F.when(has_row, F.col("gap"))).alias("gap"),
        *_sums("all", windows), *_sums("col", windows), *_sums("cell", windows, "col", has_row))
    component = (
        F.when(F.col("is_row"), "row")
        .when(F.col("line").isNotNull() & (F.col("first_row") != F.col("last_row")), "column")
        .when(F.col("line").isNotNull() & F.col("first_row").isNotNull(),
              F.when(F.col("gap") <= cell_gap, "cell").otherwise("random"))
    )
    own = [
        F.when(F.col("component") == "row", F.col(f"all_{w}")).when(F.col("component") == "column", F.col(f"col_{w}"))
        .when(F.col("component").isNotNull(), F.col(f"cell_{w}")).otherwise(0).alias(f"own_{w}") for w in windows
    ]
    return groups.withColumn("component", component).select(
        *SERVER, *BANK, "component", "first_row", "last_row",
        F.when(F.col("component") != "column", F.col("first_row")).alias("row_no"),
        F.when(~F.col("is_row"), F.col("line")).alias("col_no"),
        "n", "n_rows", *[f"all_{w}" for w in windows], *own)


def _bank_classes(fine: DataFrame, windows, min_errors) -> DataFrame:
    """Per (bank, fine class): sums, and ``coarse``, the coarsest faulty group the bank lies in.

    A server has 24 slots of at most 8 ranks of 64 banks, so the windows below see at most some
    ten thousand rows per server, whatever the log's size.
    """
    banks = fine.groupBy(*SERVER, *BANK, "component").agg(
        F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"),
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
        *_sums("all", windows), *_sums("own", windows))
    slot = F.col("memoryid")
    banks = banks.withColumns({"socketid": socketid(slot), "channelid": channelid(slot)})
    socket = W.partitionBy(*SERVER, "socketid")
    channel = W.partitionBy(*SERVER, "socketid", "channelid")
    bank = W.partitionBy(*SERVER, *BANK)
    named = F.col("rankid").isNotNull() & F.col("bankid").isNotNull()
    key = F.when(named, F.struct(slot, "rankid", "bankid"))
    socket_fault = (F.sum("n").over(socket) > min_errors) & (
        F.min("channelid").over(socket) != F.max("channelid").over(socket))
    channel_fault = (F.sum(F.when(named, F.col("n"))).over(channel) > min_errors) & (
        F.min(key).over(channel) != F.max(key).over(channel))
    bank_fault = named & (F.sum("n_rows").over(bank) > min_errors) & (
        F.min("first_row").over(bank) != F.max("last_row").over(bank))
    coarse = F.when(socket_fault, "socket").when(channel_fault, "channel").when(bank_fault, "bank")
    return banks.repartition(*SERVER).withColumn("coarse", coarse)


def component_breakdown(log, tickets, inventory, windows=WINDOWS, min_errors=MIN_ERRORS, cell_gap=CELL_GAP, rows=None) -> DataFrame:
    """Errors and servers per (failure_type, window, component).

    The class of an error is decided over all errors of its failure type, before the window is
    applied. Errors that are neither cell nor random (no row or column number) are not reported. ``rows``: of
    ``second_counts``.
    """
    banks = _bank_classes(fine_classes(log, tickets, inventory, windows, cell_gap, rows), windows, min_errors)
    faulty = F.col("coarse").isNotNull()
    picked = banks.select(
        *SERVER, F.coalesce("coarse", "component").alias("component"),
        *[F.when(faulty, F.col(f"all_{w}")).otherwise(F.col(f"own_{w}")).alias(f"n_{w}") for w in windows])
    servers = picked.filter(F.col("component").isNotNull()).groupBy(*SERVER, "component").agg(*_sums("n", windows))
    wide = servers.groupBy("failure_type", "component").agg(
        *_sums("n_ce", windows, "n"), *[F.count_if(F.col(f"n_{w}") > 0).alias(f"n_sid_{w}") for w in windows])
    keys = ["failure_type", "component"]
    rows = unpivot_windows(wide, keys, ["n_ce", "n_sid"], windows)
    frame = scaffold(log.sparkSession, windows, other_types(tickets), component=COMPONENTS)
    return fill(rows, frame, [*keys, "window"], ["n_ce", "n_sid"])


# Which address columns name a fault of each class.
ADDRESS = {
    "socketid": COMPONENTS, "channelid": COMPONENTS[1:], "dimmid": COMPONENTS[2:], "rankid": COMPONENTS[2:],
    "bankid": COMPONENTS[2:], "row_no": ["row", "cell", "random"], "col_no": ["column", "cell", "random"],
}


def faults(log, tickets, inventory, component=None, min_errors=MIN_ERRORS, cell_gap=CELL_GAP) -> DataFrame:
    """The classified groups themselves: failure type, server, class, address and errors, one row each.

    Address columns finer than the class are NULL. ``component`` keeps one class.
    """
    whole = {"log": float("-inf")}
    fine = fine_classes(log, tickets, inventory, whole, cell_gap)
    coarse = _bank_classes(fine, whole, min_errors).filter(F.col("coarse").isNotNull()).select(
        *SERVER, *BANK, "coarse").distinct()
    same = [fine[c].eqNullSafe(coarse[c]) for c in [*SERVER, *BANK]]
    joined = fine.join(coarse, same, "left").select(
        fine["*"], "coarse").withColumn("component", F.coalesce("coarse", "component"))
    joined = joined.withColumn("n_errors", F.when(F.col("coarse").isNotNull(), F.col("n")).otherwise(F.col("own_log")))
    keep = F.col("component").isNotNull() if component is None else F.col("component") == component
    slot = F.col("memoryid")
    joined = joined.filter(keep).withColumns(
        {"socketid": socketid(slot), "channelid": channelid(slot), "dimmid": dimmid(slot)})
    masked = [F.when(F.col("component").isin(classes), F.col(c)).alias(c) for c, classes in ADDRESS.items()]
    return joined.groupBy("component", *SERVER, *masked).agg(F.sum("n_errors").alias("n_errors"))


def _parts(log, tickets, inventory, windows, parts, thresholds):
    """Rows of ``component_breakdown`` for the windows; ``parts``: ready rows of all windows."""
    if parts is None:
        return component_breakdown(log, tickets, inventory, windows, **thresholds)
    return parts.filter(F.col("window").isin(list(windows)))


def failure_share(log, tickets, inventory, window="5m", predictable=None, parts=None, **thresholds) -> DataFrame:
    """Servers with each class before a window / predictable servers of the type.

    ``predictable``: (failure_type, window, n_sid), computed from the inputs by default."""
    windows = {window: WINDOWS[window]}
    parts = _parts(log, tickets, inventory, windows, parts, thresholds)
    totals = predictable_counts(log, tickets, inventory, windows) if predictable is None else predictable
    totals = totals.select("failure_type", "window", F.col("n_sid").alias("n_predictable"))
    out = parts.drop("n_ce").join(F.broadcast(totals), ["failure_type", "window"], "left")
    return out.withColumn("fraction", F.try_divide("n_sid", "n_predictable"))


def error_share(log, tickets, inventory, window="5m", parts=None, **thresholds) -> DataFrame:
    """Errors of each class before a window / errors of the seven classes."""
    parts = _parts(log, tickets, inventory, {window: WINDOWS[window]}, parts, thresholds)
    total = F.sum("n_ce").over(W.partitionBy("failure_type", "window"))
    return parts.drop("n_sid").withColumn("n_total", total).withColumn("fraction", F.try_divide("n_ce", "n_total"))


def error_breakdown(log, tickets, inventory, windows=WINDOWS, errors=None, parts=None, **thresholds) -> DataFrame:
    """Channel, bank, row and column errors before each window / all errors of the type.

    ``errors``: (failure_type, n_errors), by default all rows of the joined log."""
    parts = _parts(log, tickets, inventory, windows, parts, thresholds).drop("n_sid")
    if errors is None:
        errors = failure_rows(log, tickets, inventory, []).groupBy("failure_type").agg(F.sum("n").alias("n_errors"))
    out = parts.filter(F.col("component").isin(COMPONENTS[1:5])).join(F.broadcast(errors), "failure_type", "left")
    return out.withColumn("fraction", F.try_divide("n_ce", "n_errors"))


def _hard_cells(log, tickets, inventory, windows, hard_span, rows=None):
    rows = failure_rows(log, tickets, inventory, CELL) if rows is None else rows
    return rows.groupBy(*SERVER, *CELL).agg(
        F.sum("n").alias("n"), *per_window(F.col("n"), "n", windows),
        (F.max("t") - F.min("t") > hard_span).alias("is_hard"))


def hard_cells(log, tickets, inventory, hard_span=HARD_SPAN) -> DataFrame:
    """Per cell of a failed server: whether its errors span more than half a day, over all its errors."""
    cells = _hard_cells(log, tickets, inventory, {}, hard_span)
    return cells.groupBy("sid", *CELL).agg(F.max("is_hard").alias("is_hard"), F.sum("n").alias("n_errors"))


def mean_hard_soft(log, tickets, inventory, windows=WINDOWS, hard_span=HARD_SPAN, rows=None) -> DataFrame:
    """Mean errors on hard and on soft cells per failed server before each window. ``rows``: of ``second_counts``."""
    cells = _hard_cells(log, tickets, inventory, windows, hard_span, rows)
    per_server = cells.groupBy(*SERVER).agg(
        *_sums("hard", windows, "n", F.col("is_hard")), *_sums("soft", windows, "n", ~F.col("is_hard")))
    return _server_means(per_server, tickets, ["hard", "soft"], windows)
