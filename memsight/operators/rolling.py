"""Spatial error classes within a rolling lookback, per (server, active window).

The class of an error is decided over the lookback of every window, so it changes as errors enter
and leave. Instead of visiting each window's lookback, every quantity of the cascade is kept as a
running sum of changes along the window grid:

* an error count rises when a window's errors enter and falls when they leave, ``lookback`` later;
* "more than one distinct part" is a count of live parts: a part enters with its first error and
  leaves when its last one does;
* which column a row's errors lie in, while there is just one, is the running sum of its live columns.

Levels go from cells to rows, column lines, banks, channels and sockets. Each level sums its changes
per window (from banks on combined before the shuffle), runs along the grid of each group (at most one
row per grid point; partitions by the number of cell rows), and hands on its changes and the classes of the recent errors. As in the batch
classes, a coarser fault overrides what was decided below it. The work is linear in the number of
(cell, window) rows; no window's lookback is listed and no pairs of rows are formed.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from memsight.constants import COMPONENTS, LOOKBACK, MIN_ERRORS
from memsight.functions.calendar import month_start
from memsight.functions.topology import BANK, channelid, socketid
from memsight.operators.features import PREFIX
from memsight.operators.windows import GRID
from memsight.session import stage, tasks

FINE = COMPONENTS[3:]


def _zero():
    return F.lit(0).cast("long")


def _if(condition, value):
    return F.when(condition, value).otherwise(_zero())


def _sum(*names):
    return [F.sum(c).alias(c) for c in names]


def _running(keys):
    return W.partitionBy("sid", "month", *keys).orderBy("rb").rowsBetween(W.unboundedPreceding, 0)


def _flip(now, before):
    """+1 when something starts to live, -1 when it ends."""
    return now.cast("long") - before.cast("long")


def _cell_changes(cells: DataFrame, lookback, freq) -> DataFrame:
    """Each (cell, window) row, and a second one where its errors leave the lookback.

    live: change in the number of live cells; entered: errors of the window, 0 in the lookback.
    Leaving rows after the month's last window are not needed; that window's bound follows from ``freq``. What happens
    before the month's first window counts from the month's start on: no window lies between.
    """
    rb, n, start = F.col("rb"), F.col("n"), month_start(F.col("month"))
    current = rb > start
    recent = _if(current, F.col("n_recent"))
    entry = F.struct(F.greatest(rb, start).alias("rb"), n.alias("n"), F.col("enters").cast("long").alias("live"),
                     _if(current, n).alias("entered"), recent.alias("recent"),
                     _if(F.col("is_close"), recent).alias("close"))
    leave = F.struct(F.greatest(rb + lookback, start).alias("rb"), (-n).alias("n"), (-F.col("leaves").cast("long")).alias("live"),
                     _zero().alias("entered"), _zero().alias("recent"), _zero().alias("close"))
    # the last window begins in its month and can end after it
    last = month_start(F.col("month") + 1) + freq
    changes = F.when(rb + lookback <= last, F.array(entry, leave)).otherwise(F.array(entry))
    return cells.select("sid", *BANK, "row_no", "loose_col", "col_no", "month", F.inline(changes))


def _rows(cells: DataFrame, lookback, freq, parts) -> DataFrame:
    """Per (row, window): live cells and columns, the row's fault, and what it hands on.

    Errors without a row number keep their columns apart (``loose_col``). The cells are dealt by row before their changes are
    listed: half as many rows to shuffle."""
    has_row, has_col = F.col("row_no").isNotNull(), F.col("col_no").isNotNull()
    row = [*BANK, "row_no", "loose_col"]
    live_col = _if(has_col, F.col("live"))
    dealt = cells.withColumn("loose_col", F.when(~has_row, F.col("col_no"))).repartition(parts, "sid", "month", *row)
    per = _cell_changes(dealt, lookback, freq).groupBy("sid", "month", *row, "rb").agg(
        *_sum("n", "live", "entered", "recent"),
        F.sum(live_col).alias("cols"), F.sum(live_col * F.coalesce("col_no", _zero())).alias("col_sum"),
        F.sum(_if(has_col, F.col("recent"))).alias("recent_col"),
        F.sum(_if(has_col, F.col("close"))).alias("close_col"))
    run = _running(row)
    per = per.withColumns({c + "_now": F.sum(c).over(run) for c in ("live", "cols", "col_sum")})
    now, before = F.col("cols_now"), F.col("cols_now") - F.col("cols")
    line_now = F.when(now == 1, F.col("col_sum_now"))
    line_before = F.when(before == 1, F.col("col_sum_now") - F.col("col_sum"))
    moved = ~line_now.eqNullSafe(line_before)
    return per.withColumns({
        "fault": has_row & (now > 1),
        "row_flip": _flip(F.col("live_now") > 0, F.col("live_now") - F.col("live") > 0),
        "line_now": line_now,
        # the column line this row joins or leaves; rows without a number are not counted in lines
        "joins": F.when(has_row & moved, line_now), "quits": F.when(has_row & moved, line_before),
    })


def _lines(rows: DataFrame, parts) -> DataFrame:
    """Per (bank, line, window): classes of the recent errors below bank level.

    A line is a faulty row, or the column shared by the rows with a single live column."""
    has_row = F.col("row_no").isNotNull()
    fields = ["is_row", "line", "n", "n_rows", "live", "live_rows", "members", "entered", "recent", "recent_col", "recent_cell", "close"]

    def piece(**given):
        return F.struct(*[given.get(f, F.lit(False) if f == "is_row" else _zero()).alias(f) for f in fields])

    own = piece(
        is_row=F.col("fault"), line=F.when(F.col("fault"), F.col("row_no")).otherwise(F.col("line_now")),
        n=F.col("n"), n_rows=_if(has_row, F.col("n")), live=F.col("row_flip"), live_rows=_if(has_row, F.col("row_flip")),
        entered=F.col("entered"), recent=F.col("recent"), recent_col=F.col("recent_col"),
        recent_cell=_if(has_row, F.col("recent_col")), close=_if(has_row, F.col("close_col")))
    one = F.lit(1).cast("long")
    pieces = F.array_compact(F.array(
        own,
        F.when(F.col("joins").isNotNull(), piece(line=F.col("joins"), members=one)),
        F.when(F.col("quits").isNotNull(), piece(line=F.col("quits"), members=-one))))
    line = [*BANK, "is_row", "line"]
    per = rows.select("sid", "month", *BANK, "rb", F.inline(pieces)).groupBy("sid", "month", *line, "rb").agg(*_sum(*fields[2:]))
    per = per.repartition(parts, "sid", "month", *line)
    members = F.sum("members").over(_running(line))
    is_row, column = F.col("is_row"), ~F.col("is_row") & F.col("line").isNotNull() & (F.col("members_now") > 1)
    single = ~is_row & ~column & F.col("line").isNotNull()
    return per.withColumn("members_now", members).withColumns({
        "row": _if(is_row, F.col("recent")), "column": _if(column, F.col("recent_col")),
        "cell": _if(single, F.col("close")), "random": _if(single, F.col("recent_cell") - F.col("close")),
    })


def _level(parts: DataFrame, keys, counted, distinct, name, below, min_errors, complete=None, spread=None) -> DataFrame:
    """One level above lines: fault if more than ``min_errors`` live errors on more than one live part.

    ``counted`` and ``distinct``: the change columns of those two numbers. A fault takes all recent
    errors of its group. ``spread``: (partitions, keys) to shuffle the combined rows to, where ``parts`` is not dealt so.
    """
    fields = list(dict.fromkeys(["n", "live", "entered", "recent", counted, distinct, *below]))
    per = parts.groupBy("sid", "month", *keys, "rb").agg(*_sum(*fields))
    if spread:
        per = per.repartition(spread[0], *spread[1])
    run = _running(keys)
    per = per.withColumns({"live_now": F.sum("live").over(run), "_errors": F.sum(counted).over(run),
                           "_parts": F.sum(distinct).over(run)})
    fault = (F.col("_errors") > min_errors) & (F.col("_parts") > 1)
    if complete is not None:
        fault = complete & fault
    classes = {c: F.when(F.col("_fault"), _zero()).otherwise(F.col(c)) for c in below}
    classes[name] = _if(F.col("_fault"), F.col("recent"))
    per = per.withColumn("_fault", fault).withColumns(classes)
    return per.withColumn("live", _flip(F.col("live_now") > 0, F.col("live_now") - F.col("live") > 0))


def component_features(cells: DataFrame, freq: int, lookback=LOOKBACK, min_errors=MIN_ERRORS, staged=False) -> DataFrame:
    """Recent errors of each class per (sid, month, rb), over the active windows of the months. ``freq`` is the one
    that ``cells`` were made with. ``cells`` are counted: hand in a staged table. ``staged`` writes the line level to the shared folder."""
    parts = tasks(cells)
    lines = _lines(_rows(cells, lookback, freq, parts), parts)
    if staged:   # the shuffle files of the fine levels are gone when those of the coarse ones are made
        lines = stage(lines)
    named = F.col("rankid").isNotNull() & F.col("bankid").isNotNull()
    slot = F.col("memoryid")
    lines = lines.withColumns({"socketid": socketid(slot), "channelid": channelid(slot)})
    # what is left of a server and month is at most a row per bank and grid point, whatever its errors
    banks = _level(lines, ["socketid", "channelid", *BANK], "n_rows", "live_rows", "bank", FINE, min_errors, named,
                   (parts, ["sid", "month", "socketid", "channelid"]))
    banks = banks.withColumns({"n_named": _if(named, F.col("n")), "live_named": _if(named, F.col("live"))})
    channels = _level(banks, ["socketid", "channelid"], "n_named", "live_named", "channel",
                      ["bank", *FINE], min_errors)
    sockets = _level(channels, ["socketid"], "n", "live", "socket", ["channel", "bank", *FINE], min_errors,
                     spread=(parts, ["sid", "month"]))
    return (
        sockets.groupBy(*GRID).agg(F.sum("entered").alias("entered"),
                                   *[F.sum(c).alias(f"{PREFIX}{c}_error") for c in COMPONENTS])
        .filter(F.col("entered") > 0).drop("entered")
    )
