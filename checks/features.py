"""Registered queries of the feature tables, with their DuckDB text: every window's lookback listed."""

from pyspark.sql import functions as F

from checks import fixture
from checks.fixture import ROLLING_ERRORS
from checks.sqltext import LOG, cascade, query, text
from memsight.constants import COMPONENTS, FREQUENCIES
from memsight.functions.topology import CELL
from memsight.operators import features, rolling, windows
from memsight.operators.windows import GRID
from memsight.operators.features import feature_columns
from memsight.plans.features import feature_table
from memsight.session import stage

MONTHS = (6, 7, 8)   # the months that feature tables are published for


def _cells(spark, d, freq, months=MONTHS):
    return windows.cell_windows(fixture.log(spark, d), FREQUENCIES[freq], months)


def rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _f2(spark, d):
    cells = windows.in_month(_cells(spark, d, "5m"))
    return cells.select("sid", "rb", *CELL, "is_hard")


def _f3(freq):
    return lambda s, d: rounded(features.counter_features(_cells(s, d, freq)).drop("month"))


def _f4(freq):
    return lambda s, d: rolling.component_features(stage(_cells(s, d, freq)), FREQUENCIES[freq], min_errors=ROLLING_ERRORS).drop("month")


def _f5(freq, swap=False):
    return lambda s, d: rounded(features.statistical_features(stage(_cells(s, d, freq)), swap).drop("month"))


def _f6(spark, d):
    log, _, inventory = fixture.inputs(spark, d)
    return features.with_one_hot(windows.active_windows(log, FREQUENCIES["30m"], MONTHS), inventory).drop("month")


def _f7(freq, months=MONTHS):
    def run(spark, d):
        log, _, inventory = fixture.inputs(spark, d)
        return rounded(feature_table(log, inventory, freq, months, ROLLING_ERRORS).drop("t_predict"))
    return run


QUERIES = {
    "f1_active_windows": lambda s, d: windows.active_windows(
        fixture.log(s, d), FREQUENCIES["5m"], range(1, 9)).select(*GRID),
    "f2_rolling_hard": _f2,
    "f3_counter_5m": _f3("5m"),
    "f3_counter_5d": _f3("5d"),
    "f4_component_5m": _f4("5m"),
    "f4_component_30m": _f4("30m"),
    "f4_component_5d": _f4("5d"),
    "f5_statistical_5m": _f5("5m"),
    "f5_statistical_5d": _f5("5d"),
    "f5_statistical_swapped": _f5("1h", True),
    "f6_one_hot": _f6,
    "f7_features_5m": _f7("5m"),
    "f7_features_1h": _f7("1h"),
    "f7_features_5d_all_months": _f7("5d", range(1, 9)),
}

STARTS = ("(VALUES (1,86400,86400,2764800),(2,86400,2764800,5356800),(3,2764800,5356800,8035200),"
          "(4,5356800,8035200,10713600),(5,8035200,10713600,13219200),(6,10713600,13219200,15897600),"
          "(7,13219200,15897600,18489600),(8,15897600,18489600,21340800))")


def _windows(freq, months):
    step = FREQUENCIES[freq]
    wanted = ", ".join(str(m) for m in months)
    return LOG + f""",
months(month, last_first, first, next_first) AS (SELECT * FROM {STARTS}),
located AS (SELECT l.*, CASE WHEN memoryid < 12 THEN 0 ELSE 1 END AS socketid, (memoryid % 12) // 2 AS channelid,
  memoryid % 2 AS dimmid FROM log l),
active AS (SELECT DISTINCT sid, month, first + ((t - first) // {step} + 1) * {step} AS rb, last_first, next_first
  FROM located JOIN months ON t >= first AND t < next_first WHERE month IN ({wanted})),
looked AS (
  SELECT l.*, month, rb, l.t >= rb - {step} AS in_window, l.t >= rb - 300 AS recent FROM active a JOIN located l USING (sid)
  WHERE l.t < rb AND l.t >= rb - 2592000 AND l.t >= last_first AND l.t < next_first)"""


HARD = """
hard AS (SELECT sid, month, rb, memoryid, rankid, bankid, row_no, col_no, max(t) - min(t) > 43200 AS is_hard,
  bool_or(in_window) AS here FROM looked GROUP BY ALL),
flagged AS (SELECT k.*, is_hard FROM looked k JOIN hard h ON k.sid = h.sid AND k.month = h.month AND k.rb = h.rb
  AND k.memoryid = h.memoryid AND k.rankid = h.rankid AND k.bankid = h.bankid
  AND k.row_no IS NOT DISTINCT FROM h.row_no AND k.col_no IS NOT DISTINCT FROM h.col_no WHERE in_window)"""

COUNTER = """
counter AS (
  SELECT sid, month, rb, count(*) AS "5min_counter", round(coalesce(avg(gap), 0), 6) AS "5min_mtbe",
    count(*) FILTER (error_type = 1) AS "5min_read", count(*) FILTER (error_type = 2) AS "5min_scrub",
    count(*) FILTER (NOT is_hard) AS "5min_soft", count(*) FILTER (is_hard) AS "5min_hard"
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY sid, month, rb ORDER BY t) AS gap FROM flagged) GROUP BY ALL)"""

ROLLING = cascade("looked", "sid, month, rb", ROLLING_ERRORS) + """,
component AS (
  SELECT a.sid, a.month, a.rb, """ + ", ".join(
    f"count(*) FILTER (recent AND component = '{c}') AS \"5min_{c}_error\"" for c in COMPONENTS) + """
  FROM active a JOIN classed k USING (sid, month, rb) GROUP BY ALL)"""


def _statistical(swap=False):
    parts = []
    for level, keys in features.STAT_LEVELS.items():
        names = ", ".join(keys)
        whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        parts.append(f"""
{level}_stat AS (SELECT sid, month, rb, count(*) AS c, avg(n) AS a, median(n) AS m, coalesce(stddev_samp(n), 0) AS s
  FROM (SELECT sid, month, rb, {names}, count(*) AS n FROM looked WHERE in_window AND {whole} GROUP BY ALL) GROUP BY ALL)""")
    middle, spread = ("s", "m") if swap else ("m", "s")
    columns = ", ".join(
        f"""coalesce({v}.c, 0) AS "5min_{v}_count", round(coalesce({v}.a, 0), 6) AS "5min_{v}_mean",
        round(coalesce({v}.{middle}, 0), 6) AS "5min_{v}_median", round(coalesce({v}.{spread}, 0), 6) AS "5min_{v}_std\""""
        for v in features.STAT_LEVELS)
    joins = " ".join(f"LEFT JOIN {v}_stat {v} USING (sid, month, rb)" for v in features.STAT_LEVELS)
    return ",".join(parts) + f""",
statistical AS (SELECT sid, month, rb, {columns} FROM (SELECT DISTINCT sid, month, rb FROM active) {joins})"""


ONE_HOT = ", ".join(
    f"""CAST(EXISTS (SELECT 1 FROM inventory i WHERE i.sid = f.sid AND CAST(i.{factor} AS varchar) = '{level}') AS int) AS "{prefix}{level}\""""
    for factor, prefix in features.ONE_HOT.items() for level in features.LEVELS[factor])


def pieces(freq, months):
    return ",".join([_windows(freq, months), HARD, COUNTER, ROLLING, _statistical()])


def features_cte(freq, months):
    """CTEs ending in ``features``: the table of F7."""
    wanted = ", ".join(f'"{c}"' for c in feature_columns())
    return pieces(freq, months) + f""",
features AS (
  SELECT sid, {text('f.rb')} AS predict_time, rb AS t_predict, '{freq}' AS freq, month, {wanted}
  FROM (SELECT f.*, {ONE_HOT} FROM (SELECT * FROM counter JOIN component USING (sid, month, rb)
    JOIN statistical USING (sid, month, rb)) f) f)"""


def _sql(freq, result, columns="* EXCLUDE (month)", months=MONTHS):
    extra = {"counter": HARD + "," + COUNTER, "component": ROLLING, "statistical": _statistical()}[result]
    return query(f"SELECT {columns} FROM {result}", _windows(freq, months) + "," + extra)


ORACLE = {
    "f1_active_windows": query("SELECT sid, month, rb FROM active", _windows("5m", range(1, 9))),
    "f2_rolling_hard": query("SELECT sid, rb, memoryid, rankid, bankid, row_no, col_no, is_hard FROM hard WHERE here",
                             _windows("5m", MONTHS) + "," + HARD),
    "f3_counter_5m": _sql("5m", "counter"),
    "f3_counter_5d": _sql("5d", "counter"),
    "f4_component_5m": _sql("5m", "component"),
    "f4_component_30m": _sql("30m", "component"),
    "f4_component_5d": _sql("5d", "component"),
    "f5_statistical_5m": _sql("5m", "statistical"),
    "f5_statistical_5d": _sql("5d", "statistical"),
    "f5_statistical_swapped": query("SELECT * EXCLUDE (month) FROM statistical",
                                    _windows("1h", MONTHS) + "," + _statistical(True)),
    "f6_one_hot": query(f"SELECT sid, rb, {ONE_HOT} FROM active f", _windows("30m", MONTHS)),
    "f7_features_5m": query("SELECT * EXCLUDE (t_predict) FROM features", features_cte("5m", MONTHS)),
    "f7_features_1h": query("SELECT * EXCLUDE (t_predict) FROM features", features_cte("1h", MONTHS)),
    "f7_features_5d_all_months": query("SELECT * EXCLUDE (t_predict) FROM features", features_cte("5d", range(1, 9))),
}
