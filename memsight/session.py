"""Session helper and the shared-folder lookup."""

import math
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app="memsight", master=None, **conf):
    """A session with the settings the jobs assume; a cluster's own settings win over these.

    Shuffle partitions are left to the cluster (AQE coalesces them); pass
    ``**{"spark.sql.shuffle.partitions": n}`` for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # recording the Python call site of every column doubles the time to build a wide plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # a run generates more classes than the default cache of 100 holds
        "spark.sql.codegen.cache.maxEntries": "2000",
        # groupings by cell and window have too many keys for the small first-level hash map
        "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged data: ``spark.checkpoint.dir``. Where unset, a new temporary one with a local master
    (tests); executors of a cluster would not see each other's temporary folders, so there it raises."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share (master: {master})")
        path = getattr(shared_dir, "_local", None)
        if path is None:
            path = shared_dir._local = tempfile.mkdtemp(prefix="memsight-", dir=os.environ.get("TMPDIR", "/tmp"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_owners: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession):
    """Owner of what is staged inside: a run whose results are written within removes its staged folders at the end."""
    _owners.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _owners.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged_path(spark: SparkSession, kind="stage") -> str:
    """A new folder below the shared one. The innermost ``staging`` owns it; without one it stays, as lazy results may still
    read it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


TASK_ROWS = 200_000   # of one task of a wide shuffle: its sorted rows then take some 300 MB


def tasks(rows: DataFrame, task_rows=TASK_ROWS) -> int:
    """Partitions for a shuffle of ``rows``: as many as its count asks for, one a core at least. Rows are counted, as shuffled
    bytes do not tell: repetitive rows compress to a fiftieth of what sorting them takes, so partitions that adaptive execution
    merges up to a number of bytes, or a fixed number of them, make tasks that grow with the input. ``rows`` should be cheap
    to count: a stored or staged table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / task_rows))


CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Shuffle files of what is run inside go when it ends. Else they stay until the driver's JVM happens to collect its plan: those of
    a feature table are ten times its size, and would lie beside all that is made from it."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before) if before is not None else spark.conf.unset(CLEANUP_CONF)


def _written(df: DataFrame, path, by=(), codec=None) -> DataFrame:
    out = df.write.option("compression", codec) if codec else df.write
    with clean_shuffles(df.sparkSession):
        out.partitionBy(*by).parquet(path) if by else out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, by=(), codec=None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several readers, and retries after a lost
    executor, then start from columnar files instead of recomputing the whole lineage. ``by``: columns with a folder for
    each value, of which readers then take only those they filter by. The shuffle files of the lineage go."""
    return _written(df, staged_path(df.sparkSession), by, codec)


def stage_made(spark: SparkSession, make) -> DataFrame:
    """``make()``, staged; what it has staged on the way goes."""
    path = staged_path(spark)
    with staging(spark):
        return _written(make(), path)
