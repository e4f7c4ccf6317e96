"""Input tables: the error log, the inventory and the trouble tickets."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memsight.functions.calendar import month_of, offset_all_time
from memsight.session import clean_shuffles

WRITE_ERROR = 3


def _schema(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def log_schema(sid=T.LongType()):
    return _schema(
        ("sid", sid), ("memoryid", T.LongType()), ("rankid", T.LongType()), ("bankid", T.LongType()),
        ("row", T.LongType()), ("col", T.LongType()), ("error_type", T.IntegerType()), ("error_time", T.StringType()),
    )


def inventory_schema(sid=T.LongType()):
    return _schema(
        ("sid", sid), ("DRAM_model", T.StringType()), ("DIMM_number", T.IntegerType()),
        ("server_manufacturer", T.StringType()),
    )


def ticket_schema(sid=T.LongType()):
    return _schema(("sid", sid), ("failed_time", T.StringType()), ("failure_type", T.LongType()))


def _read_csv(spark, path, schema):
    """Columns are matched to the schema by header name, so their order is free, as long as all files of the path have
    the same one: a file with another header raises instead of being read into the wrong columns."""
    names = spark.read.option("header", True).csv(path).columns
    by_name = {field.name: field for field in schema}
    in_file = T.StructType([by_name.get(n, T.StructField(n, T.StringType())) for n in names])
    return (
        spark.read.schema(in_file).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
        .select(*schema.names)
    )


def error_log(raw: DataFrame) -> DataFrame:
    """Name the address columns, drop write errors and add ``t``, the offset of ``error_time``."""
    for old, new in (("row", "row_no"), ("col", "col_no")):
        if old in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    return raw.filter(F.col("error_type") < WRITE_ERROR).withColumn("t", offset_all_time(F.col("error_time")))


def trouble_tickets(raw: DataFrame) -> DataFrame:
    """Add ``failed_off``, the offset of ``failed_time``."""
    return raw.withColumn("failed_off", offset_all_time(F.col("failed_time")))


def read_error_log(spark: SparkSession, path: str, sid=T.LongType()) -> DataFrame:
    """The CSV log without write errors."""
    return error_log(_read_csv(spark, path, log_schema(sid)))


def read_inventory(spark: SparkSession, path: str, sid=T.LongType()) -> DataFrame:
    return _read_csv(spark, path, inventory_schema(sid))


def read_tickets(spark: SparkSession, path: str, sid=T.LongType()) -> DataFrame:
    return trouble_tickets(_read_csv(spark, path, ticket_schema(sid)))


def store_log(log: DataFrame, path: str) -> DataFrame:
    """Write a log as Parquet with ``t`` parsed once and a directory per month, and read it back.

    Month slices then prune directories. The rebalance hint makes files of an even size per month
    and splits those of a heavy month."""
    log = log.withColumn("month", month_of(F.col("t")))
    with clean_shuffles(log.sparkSession):
        log.hint("rebalance", F.col("month")).write.mode("overwrite").partitionBy("month").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def ingest_error_log(spark: SparkSession, csv_path: str, out: str, sid=T.LongType()) -> DataFrame:
    """The CSV log, parsed and stored once."""
    return store_log(read_error_log(spark, csv_path, sid), out)
