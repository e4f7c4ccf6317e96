"""Registered queries of the sources, scalar functions, joins and findings, with their DuckDB text."""

from pyspark.sql import functions as F

from checks import fixture
from checks.fixture import MIN_ERRORS
from checks.sqltext import COMPONENT_ROWS, DAYS, JOINED, LOG, cascade, offset, query, text
from memsight.constants import LEVELS
from memsight.functions import calendar, topology
from memsight.sources import tables
from memsight.operators import measure, prepare, spatial

CELL_COLS = "sid, memoryid, rankid, bankid, row_no, col_no"


def _rounded(df, *columns, places=8):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _m1(spark, d):
    return _rounded(measure.monthly_rates(*fixture.inputs(spark, d)), "error_rate", "failure_rate")


def _t2(spark, d):
    t = F.col("t")
    times = fixture.log(spark, d).select("error_time", "t").distinct()
    return times.select("error_time", calendar.offset_to_text(t).alias("same_time"),
                        calendar.offset_to_text(t + 432000).alias("later_time"))


def _t6(spark, d):
    return topology.with_topology(fixture.log(spark, d).select("memoryid").distinct())


def _t7(spark, d):
    rows = prepare.failure_rows(*fixture.inputs(spark, d), [])
    return rows.groupBy(calendar.lead_class(F.col("td")).cast("long").alias("lead_class")).agg(
        F.sum("n").alias("n"), F.max("td").alias("longest"))


def _t5(spark, d):
    log, tickets, _ = fixture.inputs(spark, d)
    return prepare.with_tickets(log, tickets).select(
        "sid", "error_time", "failed_time", calendar.time_diff(F.col("failed_time"), F.col("error_time")).alias("td"))


def _faults(component, *columns):
    def run(spark, d):
        out = spatial.faults(*fixture.inputs(spark, d), component, min_errors=MIN_ERRORS)
        return out.select("failure_type", "sid", *columns, "n_errors")
    return run


def _m7(spark, d):
    out = spatial.failure_share(*fixture.inputs(spark, d), min_errors=MIN_ERRORS)
    return _rounded(out, "fraction")


def _m8(spark, d):
    return _rounded(spatial.error_share(*fixture.inputs(spark, d), min_errors=MIN_ERRORS), "fraction")


def _m9(spark, d):
    return _rounded(spatial.error_breakdown(*fixture.inputs(spark, d), min_errors=MIN_ERRORS), "fraction")


def _m10(factor):
    return lambda spark, d: _rounded(measure.hardware_impact(*fixture.inputs(spark, d), factor), "fraction")


def _m1_total(spark, d):
    return _rounded(measure.overall_rates(*fixture.inputs(spark, d)),
                    "mean_error_rate", "mean_failure_rate", "overall_error_rate")


def _p4(spark, d):
    out = prepare.month_slice(fixture.log(spark, d), 6)
    return out.select("sid", "memoryid", "rankid", "bankid", "row_no", "col_no", "error_type", "error_time", "t")


QUERIES = {
    "s1_error_log": lambda s, d: tables.read_error_log(s, fixture.as_csv(s, d, "mcelog")),
    "s2_inventory": lambda s, d: tables.read_inventory(s, fixture.as_csv(s, d, "inventory")),
    "s3_tickets": lambda s, d: tables.read_tickets(s, fixture.as_csv(s, d, "trouble_tickets")),
    "t1_offset": lambda s, d: fixture.log(s, d).select(
        "sid", "error_time", calendar.offset_all_time(F.col("error_time")).alias("t")),
    "t2_offset_to_text": _t2,
    "t3_offset_within_month": lambda s, d: fixture.log(s, d).select(
        "sid", "error_time", calendar.offset_within_month(F.col("error_time")).alias("t_month")),
    "t4_month_key": lambda s, d: fixture.log(s, d).groupBy(
        calendar.month_key(F.col("error_time")).alias("month")).agg(F.count(F.lit(1)).alias("n")),
    "t5_time_diff": _t5,
    "t6_topology": _t6,
    "t7_lead_class": _t7,
    "p1_with_inventory": lambda s, d: prepare.with_inventory(
        fixture.log(s, d).drop("month"), fixture.inventory(s, d)),
    "p2_ticketed_only": lambda s, d: prepare.ticketed_only(
        fixture.log(s, d).drop("month"), fixture.tickets(s, d)),
    "p3_with_tickets": lambda s, d: prepare.with_tickets(
        fixture.log(s, d).drop("month"), fixture.tickets(s, d)),
    "p4_month_slice": _p4,
    "m1_monthly_rates": _m1,
    "m1_overall_rates": _m1_total,
    "m2_predictable": lambda s, d: _rounded(measure.predictable_fraction(*fixture.inputs(s, d)), "fraction"),
    "m3_mean_errors": lambda s, d: _rounded(measure.mean_errors(*fixture.inputs(s, d)), "mean_errors"),
    "m4_median_mtbe": lambda s, d: _rounded(measure.median_mtbe(*fixture.inputs(s, d)), "mtbe_minutes", places=6),
    "m5a_socket_faults": _faults("socket", "socketid"),
    "m5b_channel_faults": _faults("channel", "socketid", "channelid"),
    "m5c_bank_faults": _faults("bank", "socketid", "channelid", "dimmid", "rankid", "bankid"),
    "m5d_row_faults": _faults("row", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no"),
    "m5e_column_faults": _faults("column", "socketid", "channelid", "dimmid", "rankid", "bankid", "col_no"),
    "m5f_cell_faults": _faults("cell", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no", "col_no"),
    "m5g_random_errors": _faults("random", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no", "col_no"),
    "m6_component_breakdown": lambda s, d: spatial.component_breakdown(*fixture.inputs(s, d), min_errors=MIN_ERRORS),
    "m7_failure_share": _m7,
    "m8_error_share": _m8,
    "m9_error_breakdown": _m9,
    "m10_hardware_dram_model": _m10("DRAM_model"),
    "m10_hardware_dimm_number": _m10("DIMM_number"),
    "m10_hardware_manufacturer": _m10("server_manufacturer"),
    "m11_failure_rate": lambda s, d: _rounded(
        measure.failure_rate(*fixture.inputs(s, d), "DRAM_model"), "failure_rate"),
    "m11_failure_rate_dimm_number": lambda s, d: _rounded(
        measure.failure_rate(*fixture.inputs(s, d), "DIMM_number"), "failure_rate"),
    "m11_failure_rate_manufacturer": lambda s, d: _rounded(
        measure.failure_rate(*fixture.inputs(s, d), "server_manufacturer"), "failure_rate"),
    "m12_failure_numbers_dimm_number": lambda s, d: measure.failure_numbers(*fixture.inputs(s, d), "DIMM_number"),
    "m12_failure_numbers": lambda s, d: measure.failure_numbers(*fixture.inputs(s, d), "DRAM_model"),
    "m12_failure_numbers_manufacturer": lambda s, d: measure.failure_numbers(
        *fixture.inputs(s, d), "server_manufacturer"),
    "m13_read_scrub": lambda s, d: _rounded(
        measure.mean_read_scrub(*fixture.inputs(s, d)), "mean_read", "mean_scrub"),
    "m14_hard_cells": lambda s, d: spatial.hard_cells(*fixture.inputs(s, d)),
    "m15_hard_soft": lambda s, d: _rounded(spatial.mean_hard_soft(*fixture.inputs(s, d)), "mean_hard", "mean_soft"),
}


def _fault_sql(component, *columns):
    cols = ", ".join(["failure_type", "sid", *columns])
    return query(f"SELECT {cols}, count(*) AS n_errors FROM classed WHERE component = '{component}' GROUP BY ALL",
                 JOINED + "," + CLASSED)


CLASSED = cascade("joined", "failure_type, sid", MIN_ERRORS, lag_extra=", failed_off")

PARTS = JOINED + "," + CLASSED + """,
parts AS (
  SELECT f.failure_type, f.win_name AS "window", c.component,
    count(k.sid) AS n_ce, count(DISTINCT k.sid) AS n_sid
  FROM frame f CROSS JOIN """ + COMPONENT_ROWS + """ c(component)
  LEFT JOIN classed k ON k.failure_type = f.failure_type AND k.component = c.component AND k.td > f.secs
  GROUP BY ALL)"""

PREDICTABLE = """
predictable AS (
  SELECT f.failure_type, f.win_name AS "window", count(DISTINCT j.sid) AS n_sid
  FROM frame f LEFT JOIN joined j ON j.failure_type = f.failure_type AND j.td > f.secs GROUP BY ALL),
failures AS (SELECT failure_type, count(*) AS n_failures FROM tickets WHERE failure_type > 0 GROUP BY ALL)"""


def _means(conditions):
    """Mean and number of servers, by counting per window, type and server."""
    counts = ", ".join(f"count(*) FILTER ({c}) AS n_{name}" for name, c in conditions.items())
    means = ", ".join(f"round(avg(n_{n}) FILTER (n_{n} > 0), 8) AS mean_{n}, count(*) FILTER (n_{n} > 0) AS servers_{n}"
                      for n in conditions)
    return f"""
    SELECT f.failure_type, f.win_name AS "window", {means}
    FROM frame f LEFT JOIN (
      SELECT f2.failure_type, f2.win_name, j.sid, {counts}
      FROM frame f2 JOIN joined_hard j ON j.failure_type = f2.failure_type AND j.td > f2.secs GROUP BY ALL) c
      ON c.failure_type = f.failure_type AND c.win_name = f.win_name GROUP BY ALL"""


HARD = """
hard AS (SELECT sid, memoryid, rankid, bankid, row_no, col_no, max(t) - min(t) > 43200 AS is_hard FROM joined GROUP BY ALL),
joined_hard AS (SELECT j.*, is_hard FROM joined j JOIN hard h ON j.sid = h.sid AND j.memoryid = h.memoryid
  AND j.rankid = h.rankid AND j.bankid = h.bankid AND j.row_no IS NOT DISTINCT FROM h.row_no
  AND j.col_no IS NOT DISTINCT FROM h.col_no)"""


def _level_rows(factor):
    listed = " UNION ALL ".join(f"SELECT '{v}' AS level" for v in LEVELS[factor])
    return f"(SELECT DISTINCT level FROM ({listed} UNION ALL SELECT coalesce(CAST({factor} AS varchar), 'unknown') FROM inventory)) v"


def _m10_sql(factor):
    return query(f"""
    SELECT f.failure_type, f.win_name AS "window", v.level, count(DISTINCT j.sid) AS n_sid, max(e.n_failures) AS n_failures,
      round(count(DISTINCT j.sid) / max(e.n_failures), 8) AS fraction
    FROM frame f CROSS JOIN {_level_rows(factor)} LEFT JOIN failures e ON e.failure_type = f.failure_type
    LEFT JOIN joined j ON j.failure_type = f.failure_type AND j.td > f.secs AND coalesce(CAST(j.{factor} AS varchar), 'unknown') = v.level
    GROUP BY ALL""", JOINED + "," + PREDICTABLE)


def _level_counts(factor):
    here = f"coalesce(CAST({factor} AS varchar), 'unknown') = v.level"
    return f"""
SELECT v.level, (SELECT count(DISTINCT sid) FROM inventory WHERE {here}) AS population,
  (SELECT count(DISTINCT sid) FROM joined WHERE {here}) AS n_failed,
  (SELECT count(DISTINCT sid) FROM joined WHERE {here}
     AND sid NOT IN (SELECT sid FROM joined WHERE td > 300)) AS n_unpredictable
FROM {_level_rows(factor)}"""


def _m11_sql(factor):
    return query(f"SELECT level, population, n_failed, round(n_failed / population * 100, 8) AS failure_rate "
                 f"FROM ({_level_counts(factor)})", JOINED)


MONTHLY = LOG + """,
monthly AS (
  SELECT '0001-0' || m.mon AS month,
    (SELECT count(DISTINCT sid) FROM log WHERE substr(error_time, 1, 7) = '0001-0' || m.mon
       AND sid IN (SELECT sid FROM inventory)) AS n_error,
    (SELECT count(DISTINCT sid) FROM tickets WHERE substr(failed_time, 1, 7) = '0001-0' || m.mon) AS n_failure,
    (SELECT count(DISTINCT sid) FROM inventory) AS population
  FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) m(mon))"""

ORACLE = {
    "s1_error_log": query("SELECT * FROM log", LOG),
    "s2_inventory": query("SELECT * FROM inventory"),
    "s3_tickets": query("SELECT * FROM tickets", LOG),
    "t1_offset": query(f"SELECT sid, error_time, {offset('error_time')} AS t FROM mcelog WHERE error_type < 3"),
    "t2_offset_to_text": query(
        f"SELECT DISTINCT error_time, {text('log.t')} AS same_time, {text('(log.t + 432000)')} AS later_time FROM log", LOG),
    "t3_offset_within_month": query(
        f"SELECT sid, error_time, t - ({DAYS.format(c='error_time')}) * 86400 AS t_month FROM log", LOG),
    "t4_month_key": query("SELECT substr(error_time, 1, 7) AS month, count(*) AS n FROM log GROUP BY ALL", LOG),
    "t5_time_diff": query("SELECT sid, error_time, failed_time, failed_off - t AS td FROM log JOIN tickets USING (sid) "
                          "WHERE failure_type > 0", LOG),
    "t6_topology": query("SELECT DISTINCT memoryid, CAST(memoryid >= 12 AS bigint) AS socketid, "
                         "(memoryid % 12) // 2 AS channelid, memoryid % 2 AS dimmid FROM log", LOG),
    "t7_lead_class": query("SELECT CAST(CASE WHEN td / 60 <= 5 THEN 1 ELSE 2 END AS bigint) AS lead_class, count(*) AS n, "
                           "max(td) AS longest FROM joined GROUP BY ALL", JOINED),
    "p1_with_inventory": query("SELECT log.*, DRAM_model, DIMM_number, server_manufacturer FROM log JOIN inventory USING (sid)", LOG),
    "p2_ticketed_only": query("SELECT * FROM log WHERE sid IN (SELECT sid FROM tickets)", LOG),
    "p3_with_tickets": query("SELECT log.*, failed_time, failed_off, failure_type, failed_off - t AS td "
                             "FROM log JOIN tickets USING (sid) WHERE failure_type > 0", LOG),
    "p4_month_slice": query("""
      SELECT sid, memoryid, rankid, bankid, row_no, col_no, error_type, error_time, t FROM log WHERE error_time LIKE '0001-06%'
      UNION ALL SELECT sid, memoryid, rankid, bankid, row_no, col_no, error_type, error_time, t FROM log
      WHERE error_time LIKE '0001-05%' AND sid IN (SELECT sid FROM log WHERE error_time LIKE '0001-06%')""", LOG),
    "m1_monthly_rates": query("SELECT *, round(n_error / population, 8) AS error_rate, "
                              "round(n_failure / population, 8) AS failure_rate FROM monthly", MONTHLY),
    "m1_overall_rates": query("""
      SELECT round(avg(n_error / population), 8) AS mean_error_rate, round(avg(n_failure / population), 8) AS mean_failure_rate,
        (SELECT count(DISTINCT sid) FROM log WHERE sid IN (SELECT sid FROM inventory)) AS n_error,
        (SELECT count(DISTINCT sid) FROM inventory) AS n_servers,
        round((SELECT count(DISTINCT sid) FROM log WHERE sid IN (SELECT sid FROM inventory))
          / (SELECT count(DISTINCT sid) FROM inventory), 8) AS overall_error_rate FROM monthly""", MONTHLY),
    "m2_predictable": query('SELECT p.*, n_failures, round(n_sid / n_failures, 8) AS fraction '
                            'FROM predictable p LEFT JOIN failures USING (failure_type)', JOINED + "," + PREDICTABLE),
    "m3_mean_errors": query(_means({"errors": "true"}), JOINED + "," + HARD),
    "m4_median_mtbe": query("""
      SELECT f.failure_type, f.win_name AS "window", count(m.sid) AS n_sid, round(median(m.mtbe) / 60, 6) AS mtbe_minutes
      FROM frame f LEFT JOIN (
        SELECT failure_type, win_name, sid, avg(gap) AS mtbe FROM (
          SELECT f2.failure_type, f2.win_name, j.sid,
            t - lag(t) OVER (PARTITION BY f2.failure_type, f2.win_name, j.sid, failed_off ORDER BY t) AS gap
          FROM frame f2 JOIN joined j ON j.failure_type = f2.failure_type AND j.td > f2.secs)
        WHERE gap IS NOT NULL GROUP BY ALL) m ON m.failure_type = f.failure_type AND m.win_name = f.win_name
      GROUP BY ALL""", JOINED),
    "m5a_socket_faults": _fault_sql("socket", "socketid"),
    "m5b_channel_faults": _fault_sql("channel", "socketid", "channelid"),
    "m5c_bank_faults": _fault_sql("bank", "socketid", "channelid", "dimmid", "rankid", "bankid"),
    "m5d_row_faults": _fault_sql("row", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no"),
    "m5e_column_faults": _fault_sql("column", "socketid", "channelid", "dimmid", "rankid", "bankid", "col_no"),
    "m5f_cell_faults": _fault_sql("cell", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no", "col_no"),
    "m5g_random_errors": _fault_sql("random", "socketid", "channelid", "dimmid", "rankid", "bankid", "row_no", "col_no"),
    "m6_component_breakdown": query("SELECT * FROM parts", PARTS),
    "m7_failure_share": query("""
      SELECT a.failure_type, a."window", component, a.n_sid, p.n_sid AS n_predictable, round(a.n_sid / p.n_sid, 8) AS fraction
      FROM parts a JOIN predictable p USING (failure_type, "window") WHERE "window" = '5m'""", PARTS + "," + PREDICTABLE),
    "m8_error_share": query("""
      SELECT failure_type, "window", component, n_ce, n_total, round(n_ce / n_total, 8) AS fraction
      FROM parts JOIN (SELECT failure_type, "window", CAST(sum(n_ce) AS bigint) AS n_total FROM parts GROUP BY ALL)
      USING (failure_type, "window") WHERE "window" = '5m'""", PARTS),
    "m9_error_breakdown": query("""
      SELECT failure_type, "window", component, n_ce, n_errors, round(n_ce / n_errors, 8) AS fraction
      FROM parts JOIN (SELECT failure_type, count(*) AS n_errors FROM joined GROUP BY ALL) USING (failure_type)
      WHERE component IN ('channel', 'bank', 'row', 'column')""", PARTS),
    "m10_hardware_dram_model": _m10_sql("DRAM_model"),
    "m10_hardware_dimm_number": _m10_sql("DIMM_number"),
    "m10_hardware_manufacturer": _m10_sql("server_manufacturer"),
    "m11_failure_rate": _m11_sql("DRAM_model"),
    "m11_failure_rate_dimm_number": _m11_sql("DIMM_number"),
    "m11_failure_rate_manufacturer": _m11_sql("server_manufacturer"),
    "m12_failure_numbers_dimm_number": query(_level_counts("DIMM_number"), JOINED),
    "m12_failure_numbers": query(_level_counts("DRAM_model"), JOINED),
    "m12_failure_numbers_manufacturer": query(_level_counts("server_manufacturer"), JOINED),
    "m13_read_scrub": query(_means({"read": "error_type = 1", "scrub": "error_type = 2"}), JOINED + "," + HARD),
    "m14_hard_cells": query(f"SELECT {CELL_COLS}, max(t) - min(t) > 43200 AS is_hard, count(*) AS n_errors "
                            "FROM joined GROUP BY ALL", JOINED),
    "m15_hard_soft": query(_means({"hard": "is_hard", "soft": "NOT is_hard"}), JOINED + "," + HARD),
}
