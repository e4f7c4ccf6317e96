"""The three inputs, projected from ``lineitem`` by text that Spark SQL and DuckDB both accept.

Some errors lack a row or column number, some servers have a model outside the published list or none, and some have a
second ticket, of the same or of another failure type."""

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from memsight.session import shared_dir, stage, tasks
from memsight.sources import tables

CTES = """
base AS (
  SELECT CASE WHEN l_suppkey % 7 < 4 THEN l_suppkey * 10 ELSE l_suppkey * 10 + l_orderkey % 10 END AS sid,
         l_suppkey % 7 AS g, l_orderkey AS ok, l_partkey AS pk, CAST(l_linenumber AS bigint) AS ln,
         CAST(l_quantity AS bigint) AS q, l_returnflag AS rf, l_linestatus AS ls
  FROM lineitem),
mcelog AS (
  SELECT sid,
    CASE g WHEN 0 THEN pk % 24 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 13 WHEN 4 THEN 2 WHEN 5 THEN 17 ELSE 22 END AS memoryid,
    CASE WHEN g < 2 THEN ln % 2 ELSE 0 END AS rankid,
    CASE WHEN g < 2 THEN pk % 16 ELSE g END AS bankid,
    CASE WHEN pk % 97 = 5 THEN NULL WHEN g = 3 THEN 77 WHEN g = 4 THEN pk % 20 WHEN g = 5 THEN 1 ELSE pk % 500 END AS row_no,
    CASE WHEN pk % 89 = 7 THEN NULL ELSE CASE g WHEN 2 THEN pk % 3 WHEN 3 THEN pk % 30 WHEN 4 THEN 9 WHEN 5 THEN 1 ELSE pk % 500 END END AS col_no,
    CASE WHEN rf = 'R' AND ls = 'F' THEN 3 WHEN rf = 'A' THEN 1 ELSE 2 END AS error_type,
    '0001-0' || CAST(1 + ok % 8 AS string) || '-' || lpad(CAST(1 + (ok % 5) * 6 AS string), 2, '0') || ' '
      || CASE WHEN pk % 5 = 0 THEN '23:' WHEN g = 5 OR pk % 2 = 0 THEN '03:' ELSE '15:' END
      || lpad(CAST(CASE WHEN g = 5 THEN 4 ELSE ln END + CASE WHEN pk % 5 = 0 THEN 50 + CASE WHEN g = 5 THEN 2 ELSE 0 END ELSE 0 END AS string), 2, '0') || ':'
      || lpad(CAST(q AS string), 2, '0') AS error_time
  FROM base),
inventory AS (
  SELECT DISTINCT sid,
    CASE WHEN sid % 31 = 4 THEN 'D9' WHEN sid % 37 = 6 THEN NULL ELSE CASE sid % 7 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2' WHEN 4 THEN 'B3' WHEN 5 THEN 'C1' ELSE 'C2' END END AS DRAM_model,
    CASE sid % 4 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 16 ELSE 24 END AS DIMM_number,
    'M' || CAST(1 + (sid % 5) % 4 AS string) AS server_manufacturer
  FROM base WHERE sid % 11 <> 0),
trouble_tickets AS (
  SELECT DISTINCT sid,
    '0001-0' || CAST(1 + sid % 8 AS string) || '-' || lpad(CAST(1 + (sid % 5) * 6 + sid % 2 AS string), 2, '0') || ' 03:06:30' AS failed_time,
    ((sid - sid % 10) * 7 + sid % 10) % 4 AS failure_type
  FROM base WHERE sid % 13 < 7
  UNION ALL
  SELECT DISTINCT sid, '0001-0' || CAST(1 + (sid + 3) % 8 AS string) || '-11 07:08:09' AS failed_time,
    CASE WHEN sid % 5 = 0 THEN 1 + sid % 3 ELSE ((sid - sid % 10) * 7 + sid % 10) % 4 END AS failure_type
  FROM base WHERE sid % 13 < 7 AND sid % 6 = 1)"""

MIN_ERRORS = 100     # batch classes: the default of 1000 is too high for this data
ROLLING_ERRORS = 20  # rolling classes


@lru_cache(maxsize=16)
def _lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def projected(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _lineitem(spark, sf_dir).createOrReplaceTempView("lineitem")
    return spark.sql(f"WITH {CTES} SELECT * FROM {name}")


def as_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """An input as a folder of CSV files with the published header names, in another column order than the schema's."""
    rows, path = projected(spark, sf_dir, name), f"{shared_dir(spark)}/csv-{name}-{uuid.uuid4().hex}"
    names = {"row_no": "row", "col_no": "col"}
    rows = rows.select(*[rows[c].alias(names.get(c, c)) for c in reversed(rows.columns)])
    rows.repartition(tasks(rows)).write.option("header", True).csv(path)
    return path


# The projections are stored once per session, as a deployment ingests its files once; the queries
# then scan columns, prune months and plan with real file sizes.


@lru_cache(maxsize=16)
def log(spark, sf_dir):
    rows = tables.error_log(projected(spark, sf_dir, "mcelog"))
    return tables.store_log(rows, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")


@lru_cache(maxsize=16)
def inventory(spark, sf_dir):
    return stage(projected(spark, sf_dir, "inventory"))


@lru_cache(maxsize=16)
def tickets(spark, sf_dir):
    return stage(tables.trouble_tickets(projected(spark, sf_dir, "trouble_tickets")))


def inputs(spark, sf_dir):
    return log(spark, sf_dir), tickets(spark, sf_dir), inventory(spark, sf_dir)
