"""The active windows of the feature tables, and the log reduced to (cell, window) rows.

A month's windows are ``[start + k * freq, start + (k + 1) * freq)``, named by their right bound ``rb``.
``month`` is the month whose windows a row serves: each error serves its own month and, as
lookback, the next one, so all months are computed in one pass.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.constants import CELL_GAP, HARD_SPAN, LOOKBACK, RECENT
from memsight.functions.calendar import month_of, month_start
from memsight.functions.topology import CELL
from memsight.operators.joins import is_small, join_salted
from memsight.operators.prepare import month_bounds
from memsight.session import stage, tasks

GRID = ["sid", "month", "rb"]


def right_bound(t, start, freq):
    """Right bound of the window holding ``t``; lookback windows continue the grid to the left."""
    return start + (F.floor((t - start) / freq) + 1) * freq


def _within(months):
    """``t`` in any of the months, as one range per run of adjacent months."""
    t, ranges = F.col("t"), []
    for month in sorted(set(months)):
        _, start, end = month_bounds(month)
        if ranges and ranges[-1][1] == start:
            ranges[-1][1] = end
        else:
            ranges.append([start, end])
    return reduce(or_, [(t >= start) & (t < end) for start, end in ranges])


def active_windows(log: DataFrame, freq: int, months) -> DataFrame:
    """(sid, month, rb) of windows with at least one error."""
    if "month" in log.columns:   # an ingested log is partitioned by month
        log = log.filter(F.col("month").isin(sorted(set(months))))
    rows = log.filter(_within(months)).select("sid", "t").withColumn("month", month_of(F.col("t")))
    rb = right_bound(F.col("t"), month_start(F.col("month")), freq)
    return rows.select("sid", "month", rb.alias("rb")).distinct()


def relevant_rows(log: DataFrame, months) -> DataFrame:
    """Rows of the months and of the months before them: the filter that reaches the scan."""
    wanted = sorted({m for month in months for m in (month - 1, month) if m >= 1})
    if "month" in log.columns:   # an ingested log is partitioned by month
        log = log.filter(F.col("month").isin(wanted))
    return log.filter(_within(wanted))


def _with_months(seconds: DataFrame, rows: DataFrame, months) -> DataFrame:
    """``seconds`` with ``_months``, a bit for each of the months in which the server has errors, from ``rows``.

    A server without errors in a month has no window there, and needs no lookback for it. The bits, a row a server, come
    from one scan of the times and are staged, so that their size is known."""
    own = month_of(F.col("t"))
    bit = F.when(own.isin(list(months)), F.call_function("shiftleft", F.lit(1).cast("long"), own)).otherwise(0)
    servers = stage(rows.groupBy("sid").agg(F.bit_or(bit).alias("_months")))
    if is_small(servers):
        return seconds.join(F.broadcast(servers), "sid", "left")
    return join_salted(seconds, servers, ["sid"], "left", counted=rows)


def cell_windows(log: DataFrame, freq: int, months, recent=RECENT, lookback=LOOKBACK,
                 cell_gap=CELL_GAP, hard_span=HARD_SPAN) -> DataFrame:
    """Errors per (sid, cell, month, rb), for the months' windows and their lookback.

    n, n_recent (errors in the last ``recent`` seconds of the window), reads, scrubs, first_t,
    last_t, and the state of the cell at the window's end:
    is_hard: its errors in the lookback span more than ``hard_span``;
    is_close: two consecutive errors in the lookback are at most ``cell_gap`` apart.

    Both states ask for the latest time before which something happened, so they are running
    maxima over the cell's seconds: the latest error more than ``hard_span`` before the window's
    last error, and the latest error followed by another within ``cell_gap``. If that time is
    outside the lookback, so are all earlier ones.
    enters, leaves: the lookback gains the cell with this window's errors, and loses it when they pass out.

    ``recent`` may not exceed ``freq`` (recent errors are those of the window itself), and the lookback must be whole
    windows (it moves along their grid); other values raise.

    Copies are counted per second first; a cell then has at most one row per second of the
    calendar, whatever share of the log it holds. Lookback is kept only for months in which the server has a window.
    """
    if not 0 < recent <= freq or lookback % freq:
        raise ValueError(f"recent ({recent}) must be at most freq ({freq}), and lookback ({lookback}) a multiple of it")
    rows = relevant_rows(log, months)
    seconds = rows.groupBy("sid", *CELL, "t").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("error_type") == 1).alias("reads"),
        F.count_if(F.col("error_type") == 2).alias("scrubs"))
    t = F.col("t")
    own = month_of(t)
    wanted = F.array_compact(F.array(*[F.when(m.isin(list(months)), m) for m in (own, own + 1)]))
    has = F.coalesce("_months", F.lit(-1))   # a server without an id matches no other row
    served = F.filter(wanted, lambda m: F.call_function("shiftright", has, m).bitwiseAND(1) == 1)
    # a time outside these months and the months before them has no part in their windows
    seconds = _with_months(seconds, rows, months).withColumn("served", served).drop("_months").filter(F.size("served") > 0)
    seconds = seconds.repartition(tasks(rows), "sid", *CELL)
    by_time = W.partitionBy("sid", *CELL).orderBy("t")
    previous = F.lag("t").over(by_time)
    close = F.when(F.col("n") > 1, t).when(t - previous <= cell_gap, previous)
    seconds = seconds.withColumn("_close", close).withColumns({
        "close_t": F.max("_close").over(by_time.rowsBetween(W.unboundedPreceding, 0)),
        "far_t": F.max("t").over(by_time.rangeBetween(W.unboundedPreceding, -(hard_span + 1))),
    })
    seconds = seconds.withColumn("month", F.explode("served"))
    start = month_start(F.col("month"))
    seconds = seconds.withColumn("rb", right_bound(t, start, freq))
    cells = seconds.groupBy("sid", *CELL, "month", "rb").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(t >= F.col("rb") - recent, F.col("n")).otherwise(0)).alias("n_recent"),
        F.sum("reads").alias("reads"), F.sum("scrubs").alias("scrubs"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.max("close_t").alias("close_t"), F.max("far_t").alias("far_t"))
    # the lookback ends at the start of the previous month
    previous_start = F.when(F.col("month") > 1, month_start(F.col("month") - 1)).otherwise(month_start(F.col("month")))
    oldest = F.greatest(F.col("rb") - lookback, previous_start)
    rb, along = F.col("rb"), W.partitionBy("sid", *CELL, "month").orderBy("rb")
    before, after = F.lag("rb").over(along), F.lead("rb").over(along)
    return cells.withColumns({
        "enters": before.isNull() | (before + lookback < rb),
        "leaves": after.isNull() | (after > rb + lookback),
        "is_hard": F.coalesce(F.col("far_t") >= oldest, F.lit(False)),
        "is_close": F.coalesce(F.col("close_t") >= oldest, F.lit(False)),
    }).drop("close_t", "far_t")


def in_month(cells: DataFrame) -> DataFrame:
    """Drop the lookback rows."""
    return cells.filter(F.col("rb") > month_start(F.col("month")))
