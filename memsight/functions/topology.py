"""Position of a DIMM slot: socket, channel and slot in the channel."""

from pyspark.sql import Column, functions as F

# The address columns of one DRAM cell in the log; null row or column numbers form their own cell.
CELL = ["memoryid", "rankid", "bankid", "row_no", "col_no"]
BANK = ["memoryid", "rankid", "bankid"]


def socketid(memoryid: Column) -> Column:
    return F.when(memoryid < 12, 0).otherwise(1).cast("long")


def channelid(memoryid: Column) -> Column:
    return F.floor(memoryid % 12 / 2).cast("long")


def dimmid(memoryid: Column) -> Column:
    return (memoryid % 2).cast("long")


def with_topology(df):
    slot = F.col("memoryid")
    return df.withColumns({"socketid": socketid(slot), "channelid": channelid(slot), "dimmid": dimmid(slot)})
