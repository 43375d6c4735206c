"""Month-partitioned, sorted file layout (P2, P3, P4 write, P14).

Layout: ``<root>/year=YYYY/month=MM/part-*.parquet``, rows sorted by
``(ss_id, datetime_GMT)`` inside every file, timestamps as INT64 micros so
the row-group statistics can skip time ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.functions.nan import not_nan
from pvtide.functions.timecols import month_dir_value, month_key, ts_literal, year_key
from pvtide.schema import GEN, MONTH, SS_ID, TS, YEAR

# A range of the sorted layout holds about this much of the estimated input,
# and a job has at most so many (the driver tracks every one of them).
RANGE_BYTES = 128 << 20
MAX_RANGES = 100_000
_KEPT = "_pvt_kept"
# Where a raw tree's paths have year and month.
RAW_PATH = r"/(\d{4})/(\d{1,2})/[^/]*$"


def with_month_keys(df: DataFrame) -> DataFrame:
    """Recompute ``year``/``month`` from ``datetime_GMT`` (old keys dropped)."""
    base = df.drop(YEAR, MONTH)
    return base.withColumns({YEAR: year_key(F.col(TS)), MONTH: month_key(F.col(TS))})


def sorted_month_frame(df: DataFrame, num_partitions: int | None = None,
                       one_file: bool = False, keep_keys: bool = False) -> DataFrame:
    """Readings arranged for the month layout (P2), not yet written.

    Both keys have one source: the reading time, or with ``keep_keys`` the
    frame's own ``year`` and ``month`` (P4 and P14 rewrite a layout as it
    is). Keys already in the frame are otherwise recomputed, never mixed.

    Default: range-partitioned on ``(year, month, ss_id, datetime_GMT)``,
    so a month is split into several files with disjoint id (and, for a
    very busy system, time) ranges; a dense month or a hot system never
    becomes one task. Without ``num_partitions`` the range count follows the
    input's size (``estimated_partitions``); for small inputs AQE merges
    neighbouring ranges up to ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.
    ``one_file=True`` gives the reference's one file per month (one task
    per month). The partition keys lead the in-file sort, so the writer
    does not sort again.
    """
    if keep_keys:
        if not {YEAR, MONTH} <= set(df.columns):
            raise ValueError("keep_keys needs year and month columns")
        keyed = df.withColumn("_month_dir", F.lpad(F.col(MONTH).cast("string"), 2, "0"))
    else:
        keyed = with_month_keys(df).withColumn("_month_dir", month_dir_value(F.col(TS)))
    num_partitions = num_partitions or estimated_partitions(df)
    if one_file:
        arranged = keyed.repartition(YEAR, "_month_dir")
    elif num_partitions:
        arranged = keyed.repartitionByRange(num_partitions, YEAR, "_month_dir", SS_ID, TS)
    else:
        arranged = keyed.repartitionByRange(YEAR, "_month_dir", SS_ID, TS)
    return arranged.sortWithinPartitions(YEAR, "_month_dir", SS_ID, TS)


def estimated_partitions(df: DataFrame) -> int | None:
    """Ranges of about RANGE_BYTES of the files that df reads, if that asks
    for more than ``spark.sql.shuffle.partitions`` (else None: AQE merges
    neighbouring ranges from that number down). Sources of unknown size
    count as nothing."""
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    wanted = -(-sum(s for s in sizes if s < unknown) // RANGE_BYTES)
    if wanted <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return None
    return min(wanted, MAX_RANGES)


def write_sorted_months(df: DataFrame, path: str, mode: str = "errorifexists",
                        num_partitions: int | None = None, one_file: bool = False,
                        row_group_bytes: int | None = None, keep_keys: bool = False,
                        observation: Observation | None = None) -> None:
    """Write readings as sorted month partitions.

    ``mode="overwrite"`` replaces only the months present in df. Never write onto the folder
    being read: write a new root and switch over. ``row_group_bytes`` sets
    the Parquet row-group size: smaller groups hold fewer systems each, so
    a window fetch on the sorted files skips more of them by their min/max.
    ``keep_keys`` files every row under the keys it carries. ``observation``
    gets ``rows`` and an order-free ``checksum`` of ids and times, taken by the
    tasks that write (behind the shuffle, so sampling for ranges does not count).

    Zone-aware times need ``spark.sql.parquet.outputTimestampType`` other
    than INT96 (no statistics); ``build_session`` sets it.
    """
    require_time_statistics(df)
    arranged = sorted_month_frame(df, num_partitions, one_file, keep_keys)
    if observation is not None:
        arranged = arranged.observe(observation, F.count(F.lit(1)).alias("rows"), key_checksum().alias("checksum"))
    cols = [c for c in df.columns if c not in (YEAR, MONTH)]
    writer = arranged.select(*cols, YEAR, F.col("_month_dir").alias(MONTH)).write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", int(row_group_bytes))
    writer.partitionBy(YEAR, MONTH).parquet(path)


@dataclass(frozen=True)
class Rewrite:
    """What a rewrite was seen to do with its rows."""

    rows_in: int
    dropped: int
    rows_out: int
    checksum: str


def rewrite_months(source: DataFrame, path: str, keep: Column, num_partitions: int | None = None,
                   keep_keys: bool = False, row_group_bytes: int | None = None) -> Rewrite:
    """Write the rows of ``source`` that ``keep`` holds for as sorted months
    (P2, P3, P4), and prove that no other row was lost.

    The tasks that write count all rows that reach them, those they drop and
    those they keep (``observe``, behind the shuffle, which dropped rows pass
    too). Rows that reached them must be those of the source and rows kept
    those of the files; both are counted without reading data, from Parquet
    footers where the source is a scan. Raises if either differs; ``path`` is
    then to be thrown away. ``keep`` null counts as false, as in a filter.
    """
    require_time_statistics(source)
    seen, kept = Observation(), F.coalesce(keep, F.lit(False))
    flagged = source.withColumn(_KEPT, kept)
    arranged = sorted_month_frame(flagged, num_partitions, keep_keys=keep_keys).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(_KEPT)).alias("dropped"),
        key_checksum(F.col(_KEPT)).alias("checksum"))
    cols = [c for c in source.columns if c not in (YEAR, MONTH)]
    writer = arranged.filter(F.col(_KEPT)).select(*cols, YEAR, F.col("_month_dir").alias(MONTH)).write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", int(row_group_bytes))
    writer.partitionBy(YEAR, MONTH).parquet(path)
    rows, dropped = seen.get["rows"], seen.get["dropped"]
    expected, held = source.count(), source.sparkSession.read.schema(
        T.StructType([f for f in source.schema.fields if f.name in cols])).parquet(path).count()
    if rows != expected or rows - dropped != held:
        raise RuntimeError(f"{expected} rows went in, {rows} reached the writer, {dropped} were to go, {held} are in {path}")
    return Rewrite(rows, dropped, held, seen.get["checksum"])


def key_checksum(where: Column | None = None) -> Column:
    """A checksum of ids and times (of the rows ``where`` holds for) that does
    not depend on the rows' order."""
    hashed = F.xxhash64(SS_ID, TS) if where is None else F.when(where, F.xxhash64(SS_ID, TS))
    total = F.sum(hashed.cast("decimal(20,0)"))
    return F.coalesce(total, F.lit(0).cast("decimal(30,0)")).cast("string")


def require_time_statistics(df: DataFrame) -> None:
    """Raise if the session would write df's times as INT96, without min/max."""
    zoned = any(kind == "timestamp" for _, kind in df.dtypes)
    if zoned and df.sparkSession.conf.get("spark.sql.parquet.outputTimestampType") == "INT96":
        raise ValueError("set spark.sql.parquet.outputTimestampType to TIMESTAMP_MICROS: INT96 times "
                         "carry no statistics, so window fetches could not skip row groups")


def repartition_exact_months(df: DataFrame, start=None, end=None, value: str = GEN) -> DataFrame:
    """Put every reading into the partition of its own month.

    One pass replaces the month loop: keys are recomputed from the reading
    time, so a row filed one month away (``t48`` of a month's last day) or
    further is moved, not lost. NaN readings are dropped, nulls kept.
    ``start``/``end`` optionally bound the months kept, ``[start, end)``.
    """
    out = df.filter(not_nan(value))
    if start is not None:
        out = out.filter(F.col(TS) >= ts_literal(start, dict(df.dtypes)[TS]))
    if end is not None:
        out = out.filter(F.col(TS) < ts_literal(end, dict(df.dtypes)[TS]))
    cols = [c for c in df.columns if c not in (YEAR, MONTH)]
    return with_month_keys(out.select(*cols))


def relayout_by_path(spark, path_glob: str | list[str], pattern: str = RAW_PATH,
                     columns=(SS_ID, TS, GEN)) -> DataFrame:
    """Read a raw ``.../YYYY/MM/file.parquet`` tree and attach year and month
    taken from each file's path (P14, S9); write it with
    ``write_sorted_months``. Replaces the reference's file moves."""
    raw = spark.read.parquet(*([path_glob] if isinstance(path_glob, str) else path_glob)).select(*columns, "_metadata.file_path")
    return (raw.withColumns({
        YEAR: F.regexp_extract("file_path", pattern, 1).cast("smallint"),
        MONTH: F.regexp_extract("file_path", pattern, 2).cast("tinyint")})
        .drop("file_path"))
