from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memsight.constants import LOOKBACK
from memsight.functions import calendar, topology
from tests.helpers import clock, off


def offsets(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    return [r[0] for r in df.select(calendar.offset_all_time(F.col("s"))).collect()]


def test_days_no_gregorian_month_has(spark):
    texts = ["0001-02-30 00:00:00", "0001-04-31 23:59:59", "0001-01-01 00:00:00"]
    assert offsets(spark, texts) == [off(2, 30), off(4, 31, 23, 59, 59), 86400]


def test_month_outside_the_calendar_is_null(spark):
    assert offsets(spark, ["0001-10-01 00:00:00"]) == [None]


def test_text_outside_the_range_is_null(spark):
    df = spark.createDataFrame([(86399,), (86400,), (23932799,), (23932800,)], "t long")
    texts = [r[0] for r in df.select(calendar.offset_to_text(F.col("t"))).collect()]
    assert texts == [None, "0001-01-01 00:00:00", "0001-09-30 23:59:59", None]


def test_round_trip(spark):
    times = [86400 + i * 7919 for i in range(0, 3000)]
    df = spark.createDataFrame([(t, clock(t)) for t in times], "t long, s string")
    bad = df.filter((calendar.offset_to_text(F.col("t")) != F.col("s")) | (calendar.offset_all_time(F.col("s")) != F.col("t"))
                    | (calendar.month_of(F.col("t")) != F.substring("s", 6, 2).cast("int")))
    assert bad.count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(86400, 23932799), min_size=1, max_size=50))
def test_round_trip_property(spark, times):
    df = spark.createDataFrame([(t,) for t in times], "t long")
    again = calendar.offset_all_time(calendar.offset_to_text(F.col("t")))
    assert df.filter(~again.eqNullSafe(F.col("t"))).count() == 0


def test_within_month_and_month_key(spark):
    df = spark.createDataFrame([("0001-03-02 01:02:03",)], "s string")
    row = df.select(calendar.offset_within_month(F.col("s")), calendar.month_key(F.col("s"))).first()
    assert tuple(row) == (2 * 86400 + 3723, "0001-03")


def test_lead_class(spark):
    df = spark.createDataFrame([(300,), (301,), (-5,)], "s long")
    assert [r[0] for r in df.select(calendar.lead_class(F.col("s"))).collect()] == [1, 2, 1]


def test_topology(spark):
    df = topology.with_topology(spark.range(24).withColumnRenamed("id", "memoryid"))
    for r in df.collect():
        m = r["memoryid"]
        assert (r["socketid"], r["channelid"], r["dimmid"]) == (0 if m < 12 else 1, m % 12 // 2, m % 2)


def test_frequencies_divide_the_lookback():
    from memsight.constants import FREQUENCIES

    assert all(LOOKBACK % f == 0 for f in FREQUENCIES.values())
