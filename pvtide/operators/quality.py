"""Data-quality jobs: implausible values (P4), capacity outliers (P5),
ids without metadata (P10), id overlap counts (A8), max without bad points (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvtide.functions.nan import nan_max
from pvtide.operators.indexing import with_row_index
from pvtide.operators.sizing import bounded_broadcast
from pvtide.schema import GEN, SS_ID, TS

# The reference's limits.
IMPLAUSIBLE_WH = 100_000
CAPACITY_FACTOR = 750


def remove_implausible(df: DataFrame, limit: float = IMPLAUSIBLE_WH, value: str = GEN) -> DataFrame:
    """Keep readings ``< limit`` (F10). Null and NaN readings are dropped too,
    as a comparison with them is not true. Pushed to the Parquet scan."""
    return df.filter(F.col(value) < F.lit(limit))


def capacity_outliers(readings: DataFrame, metadata: DataFrame, factor: float = CAPACITY_FACTOR,
                      op: str = "lt", index: bool = True, value: str = GEN) -> DataFrame:
    """Readings compared with the system's capacity ``kWp * factor``.

    ``op="lt"`` keeps ``generation_Wh < kWp*factor`` as the reference
    writes it; ``op="gt"`` keeps the readings above capacity (the evident
    intent). The capacity side (one row per system) is broadcast after a
    row-count check; the filter rejects nulls, so Catalyst turns the left
    join into an inner one. NaN orders above every number, so a NaN reading
    is kept by ``gt`` and dropped by ``lt``. Result sorted by
    ``(ss_id, datetime_GMT)`` with a 0-based ``index``.
    """
    cap = metadata.select(F.col(SS_ID).cast(dict(readings.dtypes)[SS_ID]).alias(SS_ID),
                          F.col("kWp"))
    cap, _ = bounded_broadcast(cap)
    joined = readings.join(cap, SS_ID, "left")
    limit = F.col("kWp") * F.lit(factor)
    if op == "lt":
        kept = joined.filter(F.col(value) < limit)
    elif op == "gt":
        kept = joined.filter(F.col(value) > limit)
    else:
        raise ValueError("op must be 'lt' or 'gt'")
    if not index:
        return kept
    return with_row_index(kept, [SS_ID, TS, value])


def distinct_ids(df: DataFrame) -> DataFrame:
    """Distinct ids (A6/A7): one hash aggregate with spill, no chunking."""
    return df.select(SS_ID).distinct()


def ids_missing_from_metadata(readings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ids that have readings but no metadata row."""
    meta_ids = metadata.select(F.col(SS_ID).cast(dict(readings.dtypes)[SS_ID]).alias(SS_ID))
    return distinct_ids(readings).join(meta_ids, SS_ID, "left_anti")


def id_overlap_counts(readings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Number of distinct ids with readings, and how many of them have metadata."""
    meta_ids = (metadata.select(F.col(SS_ID).cast(dict(readings.dtypes)[SS_ID]).alias(SS_ID))
                .distinct().withColumn("_in_meta", F.lit(1)))
    return (distinct_ids(readings).join(meta_ids, SS_ID, "left")
            .agg(F.count(F.lit(1)).alias("n_ids_with_readings"),
                 F.count("_in_meta").alias("n_ids_in_metadata")))


def max_excluding_points(readings: DataFrame, points: DataFrame, value: str = GEN) -> DataFrame:
    """Per system, the largest reading after removing the given bad
    ``(ss_id, datetime_GMT)`` points (A5, F9). NaN is skipped by the max."""
    bad = points.select(SS_ID, TS).distinct()
    return (readings.join(bad, [SS_ID, TS], "left_anti")
            .groupBy(SS_ID).agg(nan_max(value).alias(f"max_{value}")))
