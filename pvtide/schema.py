"""Column names and declared schemas of the solar dataset."""

from __future__ import annotations

from pyspark.sql import types as T

SS_ID = "ss_id"
TS = "datetime_GMT"
GEN = "generation_Wh"
START = "start_datetime_GMT"
END = "end_datetime_GMT"
YEAR = "year"
MONTH = "month"

# The metadata columns and their order in metadata.csv.
METADATA_COLUMNS = [
    "ss_id",
    "start_datetime_GMT",
    "end_datetime_GMT",
    "latitude_rounded",
    "longitude_rounded",
    "orientation",
    "tilt",
    "kWp",
]
# Columns of the provider's new extract that are not kept.
OWNER_COLUMNS = ["owner_id", "owner_name", "system_id"]
# Float fields of the metadata.
METADATA_FLOAT_COLUMNS = [
    "latitude_rounded",
    "longitude_rounded",
    "orientation",
    "tilt",
    "kWp",
]

READINGS = T.StructType([
    T.StructField(SS_ID, T.IntegerType()),
    T.StructField(TS, T.TimestampType()),
    T.StructField(GEN, T.FloatType()),
])

# Hive keys of the month layout: year=YYYY/month=MM.
PARTITIONED_READINGS = T.StructType(READINGS.fields + [
    T.StructField(YEAR, T.ShortType()),
    T.StructField(MONTH, T.ByteType()),
])

# The block form of the wide matrix: ids per block, and its column names.
BLOCK = "id_block"
BLOCK_WIDTH = 100

METADATA = T.StructType([
    T.StructField("ss_id", T.LongType()),
    T.StructField("start_datetime_GMT", T.TimestampType()),
    T.StructField("end_datetime_GMT", T.TimestampType()),
    T.StructField("latitude_rounded", T.DoubleType()),
    T.StructField("longitude_rounded", T.DoubleType()),
    T.StructField("orientation", T.DoubleType()),
    T.StructField("tilt", T.DoubleType()),
    T.StructField("kWp", T.DoubleType()),
])

# The columns of the provider's new extract.
NEW_METADATA = T.StructType([
    T.StructField("ss_id", T.LongType()),
    T.StructField("owner_id", T.StringType()),
    T.StructField("owner_name", T.StringType()),
    T.StructField("system_id", T.StringType()),
    T.StructField("latitude_rounded", T.DoubleType()),
    T.StructField("longitude_rounded", T.DoubleType()),
    T.StructField("orientation", T.DoubleType()),
    T.StructField("tilt", T.DoubleType()),
    T.StructField("kWp", T.DoubleType()),
])


def wide_schema(ids, ts_type: T.DataType = T.TimestampType()) -> T.StructType:
    """Declared schema of the system-wide matrix: time + one float per id."""
    return T.StructType([T.StructField(TS, ts_type)]
                        + [T.StructField(str(i), T.FloatType()) for i in ids])


def block_column(place: int, width: int = BLOCK_WIDTH) -> str:
    """Column of a place in a block, e.g. ``c07``."""
    return f"c{place:0{len(str(width - 1))}d}"


def wide_block_schema(width: int = BLOCK_WIDTH, extra=(), ts_type: T.DataType = T.TimestampType()) -> T.StructType:
    """Declared schema of the block form; ``extra`` lists further float columns."""
    names = [block_column(i, width) for i in range(width)] + list(extra)
    return T.StructType([T.StructField(TS, ts_type), T.StructField(BLOCK, T.LongType())]
                        + [T.StructField(c, T.FloatType()) for c in names])
