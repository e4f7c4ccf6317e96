"""Derived tables: the feature store, reports, experiment results and models."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from memsight.session import tasks


def write_features(features: DataFrame, path: str):
    """One table for all frequencies and months, a directory per (freq, month).

    Only the partitions present in ``features`` are replaced. A task sorts its rows by directory, and files of repetitive rows
    are read by bytes, millions of rows to a task: rows are dealt by their number first, in the directories' order, so that a
    task has few of them. ``features`` are counted and sampled: hand in a staged table."""
    dealt = features.repartitionByRange(tasks(features), "freq", "month", "sid")
    (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("freq", "month").parquet(path))


def read_features(spark: SparkSession, path: str, freq: str, months) -> DataFrame:
    """The feature rows of a frequency and some months; other directories are not listed for scanning."""
    return spark.read.parquet(path).filter((F.col("freq") == freq) & F.col("month").isin(list(months)))


def write_report(report: DataFrame, path: str, order=(), sep="\t"):
    """A finding (tab-separated) or an experiment result (``sep=","``) as one ordered text file.

    Reports have a row per (type, window, level): small by construction, hence the single file."""
    out = report.orderBy(*order) if order else report
    out.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_report(spark: SparkSession, path: str, schema, sep="\t") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def model_path(root: str, experiment: int, split: int, failure_type: int, variant=None) -> str:
    """``root/experiment-1/type-2/split-1/4``: a folder for each cell of an experiment."""
    cell = f"{root}/experiment-{experiment}/type-{failure_type}/split-{split}"
    return cell if variant is None else f"{cell}/{variant}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def save_model(spark: SparkSession, path: str, kind: str, params: dict, fitted=(), weights=None):
    """``path``: ``about`` (the kind of model and its parameters), and ``fitted`` (the Spark ML models) or ``weights``."""
    about = spark.createDataFrame([(kind, json.dumps(params))], "model string, params string")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")
    if fitted:
        PipelineModel(list(fitted)).write().overwrite().save(f"{path}/fitted")
    if weights is not None:
        rows = [(i, [float(x) for x in w]) for i, w in enumerate(weights)]
        spark.createDataFrame(rows, "member int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load_model(spark: SparkSession, path: str):
    """(kind, parameters, Spark ML models, weights), the last two as far as there are any."""
    about = spark.read.schema("model string, params string").json(f"{path}/about").first()
    fitted = PipelineModel.load(f"{path}/fitted").stages if exists(spark, f"{path}/fitted") else []
    weights = None
    if exists(spark, f"{path}/weights"):
        weights = [r.weights for r in spark.read.parquet(f"{path}/weights").orderBy("member").collect()]
    return about.model, json.loads(about.params), fitted, weights
