"""Pieces of DuckDB text shared by the oracle queries: naive forms of the same semantics."""

from checks.fixture import CTES

WINDOW_ROWS = ("(VALUES ('1m',60),('5m',300),('10m',600),('20m',1200),('30m',1800),('1h',3600),"
               "('1d',86400),('7d',604800),('30d',2592000))")

DAYS = "CASE substr({c}, 6, 2) WHEN '01' THEN 0 WHEN '02' THEN 31 WHEN '03' THEN 61 WHEN '04' THEN 92 " \
       "WHEN '05' THEN 123 WHEN '06' THEN 152 WHEN '07' THEN 183 WHEN '08' THEN 213 WHEN '09' THEN 246 END"


def offset(column):
    days = DAYS.format(c=column)
    return (f"CAST(((({days}) + CAST(substr({column}, 9, 2) AS bigint)) * 24 + CAST(substr({column}, 12, 2) AS bigint)) * 3600"
            f" + CAST(substr({column}, 15, 2) AS bigint) * 60 + CAST(substr({column}, 18, 2) AS bigint) AS bigint)")


def text(offset_sql):
    """Offset to text, by way of a table of month starts."""
    return f"""(SELECT '0001-0' || m.mon || '-' || lpad(CAST(({offset_sql} - m.first) // 86400 + 1 AS varchar), 2, '0')
      || ' ' || lpad(CAST(({offset_sql} - m.first) % 86400 // 3600 AS varchar), 2, '0')
      || ':' || lpad(CAST(({offset_sql} - m.first) % 3600 // 60 AS varchar), 2, '0')
      || ':' || lpad(CAST(({offset_sql} - m.first) % 60 AS varchar), 2, '0')
    FROM (VALUES (1,86400,2764800),(2,2764800,5356800),(3,5356800,8035200),(4,8035200,10713600),(5,10713600,13219200),
      (6,13219200,15897600),(7,15897600,18489600),(8,18489600,21340800),(9,21340800,23932800)) m(mon, first, next)
    WHERE {offset_sql} >= m.first AND {offset_sql} < m.next)"""


LOG = f"""
log AS (SELECT *, {offset('error_time')} AS t FROM mcelog WHERE error_type < 3),
tickets AS (SELECT *, {offset('failed_time')} AS failed_off FROM trouble_tickets)"""

JOINED = LOG + """,
joined AS (
  SELECT l.*, failed_time, failed_off, failure_type, failed_off - t AS td, DRAM_model, DIMM_number, server_manufacturer,
    CASE WHEN memoryid < 12 THEN 0 ELSE 1 END AS socketid, (memoryid % 12) // 2 AS channelid, memoryid % 2 AS dimmid
  FROM log l JOIN inventory USING (sid) JOIN tickets USING (sid) WHERE failure_type > 0),
win(win_name, secs) AS (SELECT * FROM """ + WINDOW_ROWS + """),
types(failure_type) AS (SELECT * FROM (VALUES (1), (2), (3))),
frame AS (SELECT CAST(failure_type AS bigint) AS failure_type, win_name, secs FROM types CROSS JOIN win)"""


def query(body, pieces=""):
    return f"WITH {CTES}{',' + pieces if pieces else ''}\n{body}"


# The sequential cascade of the batch classes: each step removes whole groups from the rows.
G = "failure_type, sid"
BANK = "memoryid, rankid, bankid"


def cascade(source, group, errors, order="t", lag_extra=""):
    """CTEs that end in ``classed``: ``source`` with a column ``component``, for windows or types ``group``."""
    return f"""
socket_f AS (SELECT {group}, socketid FROM {source} GROUP BY ALL HAVING count(*) > {errors} AND count(DISTINCT channelid) > 1),
r1 AS (SELECT * FROM {source} SEMI JOIN socket_f USING ({group}, socketid)),
q1 AS (SELECT * FROM {source} ANTI JOIN socket_f USING ({group}, socketid)),
channel_f AS (SELECT {group}, socketid, channelid FROM q1 WHERE rankid IS NOT NULL AND bankid IS NOT NULL
  GROUP BY ALL HAVING count(*) > {errors} AND count(DISTINCT (dimmid, rankid, bankid)) > 1),
r2 AS (SELECT * FROM q1 SEMI JOIN channel_f USING ({group}, socketid, channelid)),
q2 AS (SELECT * FROM q1 ANTI JOIN channel_f USING ({group}, socketid, channelid)),
bank_f AS (SELECT {group}, {BANK} FROM q2 WHERE row_no IS NOT NULL
  GROUP BY ALL HAVING count(*) > {errors} AND count(DISTINCT row_no) > 1),
r3 AS (SELECT * FROM q2 SEMI JOIN bank_f USING ({group}, {BANK})),
q3 AS (SELECT * FROM q2 ANTI JOIN bank_f USING ({group}, {BANK})),
row_f AS (SELECT {group}, {BANK}, row_no FROM q3 WHERE row_no IS NOT NULL GROUP BY ALL HAVING count(DISTINCT col_no) > 1),
r4 AS (SELECT * FROM q3 SEMI JOIN row_f USING ({group}, {BANK}, row_no)),
q4 AS (SELECT * FROM q3 ANTI JOIN row_f USING ({group}, {BANK}, row_no)),
col_f AS (SELECT {group}, {BANK}, col_no FROM q4 WHERE col_no IS NOT NULL GROUP BY ALL HAVING count(DISTINCT row_no) > 1),
r5 AS (SELECT * FROM q4 SEMI JOIN col_f USING ({group}, {BANK}, col_no)),
q5 AS (SELECT * FROM q4 ANTI JOIN col_f USING ({group}, {BANK}, col_no)),
gaps AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY {group}{lag_extra}, {BANK}, row_no, col_no ORDER BY {order}), 70) AS gap FROM q5),
cells AS (SELECT *, min(gap) OVER (PARTITION BY {group}, {BANK}, row_no, col_no) AS min_gap FROM gaps),
classed AS (
  SELECT *, 'socket' AS component FROM r1 UNION ALL SELECT *, 'channel' FROM r2 UNION ALL SELECT *, 'bank' FROM r3
  UNION ALL SELECT *, 'row' FROM r4 UNION ALL SELECT *, 'column' FROM r5
  UNION ALL SELECT * EXCLUDE (gap, min_gap), CASE WHEN row_no IS NULL OR col_no IS NULL THEN NULL WHEN min_gap <= 60 THEN 'cell' ELSE 'random' END FROM cells)"""


COMPONENT_ROWS = "(VALUES ('socket'),('channel'),('bank'),('row'),('column'),('cell'),('random'))"
