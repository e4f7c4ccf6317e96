import pytest
from pyspark.sql import functions as F

from memsight.sources import stores, tables


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "mcelog.csv"
    path.write_text(
        "error_time,sid,memoryid,rankid,bankid,row,col,error_type\n"
        "0001-05-29 10:00:00,7,3,0,1,5,6,1\n0001-06-01 00:00:01,7,3,0,1,,6,2\n0001-06-02 00:00:00,8,4,0,1,5,6,3\n")
    return str(path)


def test_log_drops_writes_and_matches_columns_by_name(spark, csv):
    rows = tables.read_error_log(spark, csv).orderBy("t").collect()
    assert [(r["sid"], r["row_no"], r["col_no"], r["error_type"]) for r in rows] == [(7, 5, 6, 1), (7, None, 6, 2)]


def test_ingest_prunes_months(spark, csv, tmp_path):
    log = tables.ingest_error_log(spark, csv, str(tmp_path / "log"))
    june = log.filter(F.col("month") == 6)
    assert june.count() == 1
    assert "PartitionFilters: [isnotnull(month" in june._jdf.queryExecution().executedPlan().toString()
    assert len(june.inputFiles()) == 2   # files of the table; the scan below reads one directory
    assert june.select(F.input_file_name()).distinct().count() == 1


def test_inventory_and_tickets(spark, tmp_path):
    (tmp_path / "inventory.csv").write_text("sid,DRAM_model,DIMM_number,server_manufacturer\n1,A1,8,M1\n")
    (tmp_path / "tickets.csv").write_text("sid,failed_time,failure_type\n1,0001-01-02 00:00:00,2\n")
    assert tuple(tables.read_inventory(spark, str(tmp_path / "inventory.csv")).first()) == (1, "A1", 8, "M1")
    assert tables.read_tickets(spark, str(tmp_path / "tickets.csv")).first()["failed_off"] == 2 * 86400


def test_text_server_ids(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "tickets.csv").write_text("sid,failed_time,failure_type\nsrv-1,0001-01-02 00:00:00,2\n")
    assert tables.read_tickets(spark, str(tmp_path / "tickets.csv"), T.StringType()).first()["sid"] == "srv-1"


def test_feature_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "features")
    make = lambda month, v: spark.createDataFrame([(1, v, "5m", month)], "sid long, v int, freq string, month int")
    for month, v in ((6, 1), (7, 2), (6, 3)):
        stores.write_features(make(month, v), path)
    assert {r["v"] for r in stores.read_features(spark, path, "5m", [6, 7]).collect()} == {3, 2}
    assert stores.read_features(spark, path, "5m", [7]).count() == 1


def test_report_round_trip_keeps_order(spark, tmp_path):
    report = spark.createDataFrame([("5m", 2, 0.5), ("1m", 1, None)], "window string, n long, v double")
    stores.write_report(report, str(tmp_path / "r"), ["n"])
    (part,) = [p for p in (tmp_path / "r").iterdir() if p.name.startswith("part")]
    assert part.read_text().splitlines() == ["window\tn\tv", "1m\t1\t", "5m\t2\t0.5"]


def test_model_paths():
    assert stores.model_path("m", 1, 2, 3, 4) == "m/experiment-1/type-3/split-2/4"
    assert stores.model_path("m", 4, 1, 2) == "m/experiment-4/type-2/split-1"


def test_files_of_different_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    head = "error_time,sid,memoryid,rankid,bankid,{},error_type\n"
    (folder / "a.csv").write_text(head.format("row,col") + "0001-05-29 10:00:00,7,3,0,1,5,6,1\n")
    (folder / "b.csv").write_text(head.format("col,row") + "0001-05-29 10:00:00,7,3,0,1,5,6,1\n")
    with pytest.raises(Exception):
        tables.read_error_log(spark, str(folder)).collect()


def test_the_csv_copy_has_files_by_the_number_of_rows(spark, monkeypatch):
    from checks import fixture

    counted = []
    monkeypatch.setattr(fixture, "tasks", lambda rows: counted.append(rows.count()) or 11)
    path = fixture.as_csv(spark, "/root/testdata/sf0.001", "mcelog")
    assert counted == [6000] and len(spark.read.csv(path).inputFiles()) == 11


def test_feature_store_is_written_by_the_number_of_rows(spark, tmp_path, monkeypatch):
    """Rows that are read as one partition are dealt to tasks in the order of the directories, not sorted in one."""
    monkeypatch.setattr(stores, "tasks", lambda rows: 6)
    rows = spark.range(600).selectExpr("id AS sid", "'5m' AS freq", "CAST(6 + id % 2 AS int) AS month").coalesce(1)
    stores.write_features(rows, str(tmp_path))
    files = sorted(p.name for p in tmp_path.glob("freq=5m/month=*/part-*"))
    assert 6 <= len(files) <= 8 and len({name.split("-")[1] for name in files}) == 6
    assert stores.read_features(spark, str(tmp_path), "5m", [6, 7]).count() == 600
