"""Per-system metadata: activity bounds (A2), merge (P8), refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvtide.schema import END, METADATA_COLUMNS, METADATA_FLOAT_COLUMNS, OWNER_COLUMNS, SS_ID, START, TS


def activity_bounds(readings: DataFrame) -> DataFrame:
    """First and last reading time per system (A2). Partial aggregation
    makes a system with a third of all rows as cheap as any other."""
    return (readings.groupBy(SS_ID)
            .agg(F.min(TS).alias(START), F.max(TS).alias(END)))


def dataset_bounds(readings: DataFrame, ss_id=None) -> DataFrame:
    """One-row ``(min, max)`` of the time column (A1), optionally of one
    reference system as the reference does. Stays a DataFrame."""
    df = readings if ss_id is None else readings.filter(F.col(SS_ID) == F.lit(ss_id))
    return df.agg(F.min(TS).alias("min_datetime_GMT"), F.max(TS).alias("max_datetime_GMT"))


def merge_activity_bounds(metadata: DataFrame, readings: DataFrame) -> DataFrame:
    """Merge the bounds of newly arrived readings into the metadata.

    * start is only filled when missing, never moved earlier;
    * end moves later when the new readings end later (or fills a gap);
    * ids without new readings keep their row; ids not in the metadata are
      not added (P10 reports them).
    """
    new = activity_bounds(readings.select(SS_ID, TS)).select(
        F.col(SS_ID).cast(dict(metadata.dtypes)[SS_ID]).alias(SS_ID),
        F.col(START).alias("_new_start"), F.col(END).alias("_new_end"))
    joined = metadata.join(new, SS_ID, "left")
    start = F.coalesce(F.col(START), F.col("_new_start"))
    end = F.when(F.col(END).isNull() | (F.col(END) < F.col("_new_end")), F.col("_new_end")) \
        .otherwise(F.col(END))
    out = joined.withColumns({START: start, END: end})
    cols = [c for c in METADATA_COLUMNS if c in metadata.columns]
    return out.select(*cols)


def refresh_metadata(new_extract: DataFrame, old_metadata: DataFrame, readings: DataFrame) -> DataFrame:
    """Rebuild the metadata from a new provider extract.

    Keeps extract rows whose id has readings (left semi join on the distinct
    ids; no id set on the driver), drops owner fields, narrows types
    (ids ``bigint``, floats ``float``), and carries start and end over from
    the old metadata.
    """
    ids = readings.select(F.col(SS_ID).cast("bigint").alias(SS_ID)).distinct()
    kept = (new_extract.withColumn(SS_ID, F.col(SS_ID).cast("bigint"))
            .join(ids, SS_ID, "left_semi")
            .drop(*OWNER_COLUMNS))
    kept = kept.withColumns({c: F.col(c).cast("float") for c in METADATA_FLOAT_COLUMNS
                             if c in kept.columns})
    old = old_metadata.select(F.col(SS_ID).cast("bigint").alias(SS_ID), START, END)
    joined = kept.join(old, SS_ID, "left")
    return joined.select(*METADATA_COLUMNS)


def sort_metadata(metadata: DataFrame) -> DataFrame:
    """Final order of a metadata table (O2)."""
    return metadata.orderBy(SS_ID)


def largest_systems(metadata: DataFrame, n: int = 10) -> DataFrame:
    """Top-n systems by capacity, descending with missing capacity first as
    the reference's descending sort does (O3, O4). Ties broken by id."""
    return metadata.orderBy(F.col("kWp").desc_nulls_first(), F.col(SS_ID).asc()).limit(n)
