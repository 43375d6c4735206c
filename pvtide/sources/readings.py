"""Parquet scans of readings (S1-S4, S8) and the wide matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.schema import PARTITIONED_READINGS, READINGS, TS, wide_block_schema, wide_schema


def scan_readings(spark: SparkSession, root: str, typed_keys: bool = True,
                  schema: T.StructType | None = None) -> DataFrame:
    """Month-partitioned readings ``root/year=YYYY/month=MM``.

    With ``typed_keys`` the Hive keys are ``smallint``/``tinyint`` (S1);
    otherwise Spark infers them (S2). Filters on ``year``/``month`` prune
    folders; filters on the other columns are pushed into the Parquet scan.
    """
    reader = spark.read
    if typed_keys:
        reader = reader.schema(schema or PARTITIONED_READINGS)
    return reader.parquet(root)


def scan_partition(spark: SparkSession, root: str, year: int, month: int,
                   schema: T.StructType | None = None) -> DataFrame:
    """One month folder, keeping its keys (S3): ``basePath`` is the root."""
    path = f"{root.rstrip('/')}/year={year}/month={month:02d}"
    return spark.read.schema(schema or PARTITIONED_READINGS).option("basePath", root).parquet(path)


def scan_files(spark: SparkSession, paths, schema: T.StructType | None = None) -> DataFrame:
    """Plain file or glob scan (S3, S8); file order does not matter."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*([paths] if isinstance(paths, str) else list(paths)))


def scan_wide(spark: SparkSession, paths, ids, ts_type: T.DataType = T.TimestampType()) -> DataFrame:
    """Monthly wide files under one declared schema (S4, U6): columns of
    ids missing from a file read as null, extra columns are ignored."""
    return scan_files(spark, paths, wide_schema(ids, ts_type))


def scan_wide_blocks(spark: SparkSession, paths, extra=(), ts_type: T.DataType = T.TimestampType()) -> DataFrame:
    """Monthly files of the block form under its declared schema; ``extra``
    columns that no file has read as null (S4, U6)."""
    return scan_files(spark, paths, wide_block_schema(extra=extra, ts_type=ts_type))


def narrow_readings(df: DataFrame) -> DataFrame:
    """Reading columns in order with the narrow types (F1, F5): int ids,
    float readings. The time column keeps its type (zone-less stays zone-less)."""
    return df.select(*[F.col(f.name) if f.name == TS else F.col(f.name).cast(f.dataType).alias(f.name)
                       for f in READINGS.fields])


def nanos_to_micros_timestamp(c: str, zone_less: bool = False):
    """A Parquet ``TIMESTAMP(NANOS)`` value read as a long (nanoseconds since
    the epoch) to a Spark timestamp, floored to microseconds exactly (integer
    arithmetic; a double would lose the last digits at today's magnitudes)."""
    micros = F.expr(f"(`{c}` - pmod(`{c}`, 1000)) div 1000")
    if zone_less:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return epoch + F.expr("INTERVAL '0.000001' SECOND") * micros
    return F.timestamp_micros(micros)


def scan_nanos(spark: SparkSession, paths, ts_columns=(TS,), zone_less: bool = False) -> DataFrame:
    """Parquet files with nanosecond timestamps (the reference writes
    ``Datetime("ns", "UTC")``), which Spark rejects as an illegal type.

    Needs a session with ``spark.sql.legacy.parquet.nanosAsLong`` (it is read
    when the file schema is converted; ``build_session`` sets it), and turns
    the listed columns into microsecond timestamps; instants for zone-aware
    files, ``timestamp_ntz`` with ``zone_less``.
    """
    if spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false") != "true":
        raise ValueError("set spark.sql.legacy.parquet.nanosAsLong to true to read nanosecond times")
    df = scan_files(spark, paths)
    return df.withColumns({c: nanos_to_micros_timestamp(c, zone_less) for c in ts_columns})
