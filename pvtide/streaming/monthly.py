"""Structured Streaming forms of the monthly jobs.

New month folders arrive in the readings layout; instead of re-running the
batch jobs over everything, these queries process each new file once.

* ``start_metadata_updates``: P8 as a stream. A stateful
  ``groupBy(ss_id).agg(min, max)`` in update mode keeps the bounds of
  every system since the stream began (state grows with the number of
  systems, not with the readings). Every micro-batch re-merges the systems
  whose bounds changed from the *initial* metadata with those cumulative
  bounds, and carries the other systems over from the previous version.
  The result equals the batch P8 over all readings so far, whatever order
  the files arrive in. Version ``batch_id`` is written; a replayed batch
  rewrites the same version from the same input: exactly once.
* ``start_resample``: right-closed 30-minute means (W2) with a watermark,
  appended to Parquet as windows close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pvtide.functions.timecols import right_closed_end
from pvtide.operators.metadata import merge_activity_bounds
from pvtide.schema import END, GEN, PARTITIONED_READINGS, SS_ID, START, TS


def read_readings_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Readings files as they land under the month layout (typed keys)."""
    reader = spark.readStream.schema(PARTITIONED_READINGS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(root)


def version_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/version={batch_id}"


def start_metadata_updates(spark: SparkSession, readings_root: str, initial_metadata: DataFrame,
                           out_root: str, checkpoint: str, available_now: bool = True,
                           max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep metadata start/end current as new readings arrive (P8, incremental).

    ``initial_metadata`` is the metadata before the stream; it must be the
    same on every restart from ``checkpoint``. Version ``n`` is written to
    ``out_root/version=n`` as Parquet.
    """
    bounds = (read_readings_stream(spark, readings_root, max_files_per_trigger)
              .groupBy(SS_ID).agg(F.min(TS).alias(START), F.max(TS).alias(END)))

    def merge_batch(changed: DataFrame, batch_id: int) -> None:
        previous = (initial_metadata if batch_id == 0
                    else changed.sparkSession.read.parquet(version_path(out_root, batch_id - 1)))
        ids = changed.select(F.col(SS_ID).cast("bigint").alias(SS_ID))
        # The merge takes readings; a system's cumulative bounds are two readings.
        as_readings = (changed.select(SS_ID, F.col(START).alias(TS))
                       .unionByName(changed.select(SS_ID, F.col(END).alias(TS))))
        updated = merge_activity_bounds(initial_metadata.join(ids, SS_ID, "left_semi"), as_readings)
        kept = previous.join(ids, SS_ID, "left_anti")
        merged = kept.unionByName(updated.select(*kept.columns))
        merged.write.mode("overwrite").parquet(version_path(out_root, batch_id))

    writer = (bounds.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(merge_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def resample_stream(readings: DataFrame, every: str = "30 minutes", lateness: str = "2 hours",
                    value: str = GEN, factor: float = 1.0) -> DataFrame:
    """Streaming right-closed means. The window label is computed first and
    the watermark set on it: a window is emitted once the watermark passes
    its end, later readings for it are dropped."""
    labelled = readings.select(SS_ID, right_closed_end(F.col(TS), every).alias(TS), value)
    return (labelled.withWatermark(TS, lateness)
            .groupBy(SS_ID, TS)
            .agg(F.avg(F.col(value) * F.lit(factor)).alias(value)))


def start_resample(spark: SparkSession, readings_root: str, out_path: str, checkpoint: str,
                   available_now: bool = True, **kwargs) -> StreamingQuery:
    stream = resample_stream(read_readings_stream(spark, readings_root), **kwargs)
    writer = (stream.writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
