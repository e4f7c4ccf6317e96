import os

import pytest

from memsight import session


class Cluster:
    """As much of a session as the lookup asks for."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_no_temporary_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster("local-cluster[2,1,1024]"))


def test_staged_folders_go_with_their_owner(spark):
    folder = session.shared_dir(spark).removeprefix("file:")
    with session.staging(spark):
        session.stage(spark.range(3)).count()
        inside = set(os.listdir(folder))
    kept = session.stage(spark.range(3))
    assert len(inside - set(os.listdir(folder))) == 1 and kept.count() == 3


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if str(files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_of_what_is_staged_go(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(session.CLEANUP_CONF, None)
    kept = session.stage(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(3, "k"))
    assert not _shuffle_files(spark) - before and spark.conf.get(session.CLEANUP_CONF, None) == setting
    assert kept.agg({"id": "sum"}).first()[0] == 499500


def test_what_a_staged_result_is_made_of_goes(spark, monkeypatch):
    paths, find = [], session.staged_path
    monkeypatch.setattr(session, "staged_path", lambda *a: paths.append(find(*a)) or paths[-1])
    made = session.stage_made(spark, lambda: session.stage(spark.range(5)).union(session.stage(spark.range(3))))
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [True, False, False] and made.count() == 8
