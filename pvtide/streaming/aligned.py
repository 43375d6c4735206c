"""Stateful streams of readings: deduplication (A9) and the alignment of two
series (J6, P7), each with a state that a watermark bounds.

``lateness`` is how far behind the newest reading seen so far a reading may
arrive. Within it the results are those of the batch jobs; readings that come
later are dropped, and what is older than the watermark leaves the state (the
keys of the deduplication after another ``lateness``). So the state holds at
most about twice that stretch of time, whatever the stream's length. Watermarks need instants (``timestamp``); see ``as_instants``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pvtide.schema import GEN, SS_ID, TS


def as_instants(df: DataFrame, column: str = TS) -> DataFrame:
    """Zone-free times as instants of the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup_stream(readings: DataFrame, lateness: str = "2 days") -> DataFrame:
    """One reading per system and time (A9): the first that arrives stays.

    Copies carry the same time, so a key is needed for ``lateness`` only.
    Readings without a time are dropped (a watermark cannot place them);
    a null id is a key like any other, as in the batch dedup.
    """
    timed = readings.filter(F.col(TS).isNotNull()).withWatermark(TS, lateness)
    return timed.dropDuplicatesWithinWatermark([SS_ID, TS])


def align_streams(left: DataFrame, right: DataFrame, lateness: str = "2 days", value: str = GEN,
                  names: tuple[str, str] = ("left_value", "right_value")) -> DataFrame:
    """Full outer alignment of two series on system and time.

    A pair is emitted when its second side arrives, a reading without a
    partner once the watermark (the slower series') has passed its time.
    Each series has one reading per system and time (``dedup_stream``).
    Readings without an id or a time have no partner to wait for and are
    left out.
    """
    def side(df: DataFrame, name: str, tag: str) -> DataFrame:
        known = df.filter(F.col(SS_ID).isNotNull() & F.col(TS).isNotNull())
        return known.select(F.col(SS_ID).alias(f"{tag}_id"), F.col(TS).alias(f"{tag}_ts"),
                            F.col(value).alias(name)).withWatermark(f"{tag}_ts", lateness)

    a, b = side(left, names[0], "l"), side(right, names[1], "r")
    joined = a.join(b, (F.col("l_id") == F.col("r_id")) & (F.col("l_ts") == F.col("r_ts")), "full_outer")
    return joined.select(F.coalesce("l_id", "r_id").alias(SS_ID), F.coalesce("l_ts", "r_ts").alias(TS), *names)


def append_to(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream's rows to a Parquet folder, exactly once per
    checkpoint; ``available_now`` takes what is there and stops."""
    writer = (stream.writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
