"""Window fetches beyond the broadcast bound without shuffling readings.

Readings are stored once as a bucketed table: hash buckets of ``(ss_id,
time_slot)``, a slot being a fixed stretch of time. Millions of windows are
cut at the slots they cross and join on both columns, so only the windows are
shuffled, into the table's buckets; a reading meets the windows of its own
system and slot only. The slot is part of the bucket's key, so a system with a
third of all readings is spread over the buckets by time, and no bucket
follows one system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.functions.timecols import micros_since_epoch
from pvtide.operators.layout import require_time_statistics
from pvtide.operators.sampling import W_END, W_START
from pvtide.schema import SS_ID, TS

SLOT = "time_slot"
SLOT_DAYS = 28


def time_slot(c, ts_type: str, days: int = SLOT_DAYS) -> Column:
    """Number of the stretch of ``days`` that a time falls in."""
    return F.floor(micros_since_epoch(c, ts_type) / F.lit(days * 86_400_000_000)).cast("int")


def write_bucketed(readings: DataFrame, table: str, path: str, buckets: int, days: int = SLOT_DAYS) -> None:
    """Store readings as the catalog table ``table`` with its files at
    ``path`` (a shared folder), one file per bucket, sorted by system and time.

    ``buckets``: about input bytes / 128 MB. Readings without a system or a
    time match no window, but are kept. The number of days per slot is part
    of the table (its ``pvtide.slot_days`` property); fetches read it there.
    """
    require_time_statistics(readings)
    slotted = readings.withColumn(SLOT, time_slot(TS, dict(readings.dtypes)[TS], days))
    (slotted.repartition(buckets, SS_ID, SLOT).write.option("path", path)
     .bucketBy(buckets, SS_ID, SLOT).sortBy(SS_ID, SLOT, TS).format("parquet").saveAsTable(table))
    readings.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('pvtide.slot_days' = '{int(days)}')")


def slot_days(spark: SparkSession, table: str) -> int:
    """The stretch of time of the table's slots."""
    row = spark.sql(f"SHOW TBLPROPERTIES {table} ('pvtide.slot_days')").first()
    if not row.value.isdigit():
        raise ValueError(f"{table} was not written by write_bucketed")
    return int(row.value)


def fetch_windows(spark: SparkSession, table: str, windows: DataFrame) -> DataFrame:
    """All readings of each ``(ss_id, window_start, window_end)``, closed
    range, as ``sampling.fetch_windows`` gives them; any number of windows.

    The windows are exploded to slots and shuffled to the table's buckets.
    Windows with a null id or bound, or start after end, hold no reading. A
    repeated window returns its readings as often as it occurs.
    """
    readings = spark.table(table)
    kinds, days = dict(readings.dtypes), slot_days(spark, table)
    ts_type = kinds[TS]
    wanted = windows.select(F.col(SS_ID).cast(kinds[SS_ID]).alias(SS_ID), F.col(W_START).cast(ts_type).alias(W_START),
                            F.col(W_END).cast(ts_type).alias(W_END))
    wanted = wanted.filter(F.col(SS_ID).isNotNull() & (F.col(W_START) <= F.col(W_END)))
    slots = F.sequence(time_slot(W_START, ts_type, days), time_slot(W_END, ts_type, days))
    wanted = wanted.withColumn(SLOT, F.explode(slots))
    # A merge join keeps both sides' partitioning: the windows follow the buckets.
    joined = readings.join(wanted.hint("merge"), [SS_ID, SLOT]).filter(F.col(TS).between(F.col(W_START), F.col(W_END)))
    return joined.select(*[c for c in readings.columns if c != SLOT], W_START, W_END)
