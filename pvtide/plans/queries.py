"""Registered queries: each reference job on the fixture views of the
driver's tables, ``(spark, sf_dir) -> DataFrame``.

Every query reads whole tables. Computed columns carry the names used by
the SQL twins in ``pvtide.plans.oracle``; averages are rounded to 6
decimals on both sides so that summation order cannot change the check.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.operators import (
    bucketed,
    derived,
    layout,
    metadata,
    months,
    peek,
    pivot,
    quality,
    refresh,
    resample,
    reshape,
    sampling,
    snapshots,
    spatial,
)
from pvtide.schema import (
    END,
    GEN,
    METADATA,
    METADATA_FLOAT_COLUMNS,
    MONTH,
    PARTITIONED_READINGS,
    SS_ID,
    START,
    TS,
    YEAR,
)
from pvtide.operators.sizing import reliable_checkpoint
from pvtide.session import ensure_checkpoint_dir
from pvtide.sources import fixtures as fx
from pvtide.sources.csvfiles import (
    read_metadata,
    read_new_metadata,
    read_with_rejects,
    write_csv,
    write_metadata,
)
from pvtide.streaming import aligned
from pvtide.sources.readings import narrow_readings, scan_partition, scan_readings, scan_wide_blocks

# Parameters of the registered runs.
# The reference plots the system of row 7 of its outlier table, from 100
# days before its first outlier, for 200 days.
OUTLIER_ROW = 7
OUTLIER_ROW_BEFORE_DAYS = 100
OUTLIER_ROW_LENGTH_DAYS = 200
# Bounded month repartition: [1995-01-01, 1997-01-01).
EXACT_MONTHS_START = "1995-01-01"
EXACT_MONTHS_END = "1997-01-01"
# Ordered slice of the readings: rows 1000 .. 1024.
SLICE_OFFSET = 1000
SLICE_LENGTH = 25
# A column that no wide file has, declared in the schema: read as all null.
ABSENT_COLUMN = "absent"
# One compared day, one reference system, and the months read or replaced.
COMPARED_DAY = dt.date(2024, 1, 15)
REFERENCE_SYSTEM = 42
READ_YEAR, READ_MONTH = 1996, 2
RANGE_START, RANGE_END = "1997-11-17 00:00:00", "1998-02-03 00:00:00"
REPLACED_MONTHS = ((1996, 3), (1997, 12))
OUTLIER_CONTEXT_THRESHOLD = 400.0
OUTLIER_CONTEXT_BEFORE_DAYS = 2
OUTLIER_CONTEXT_LENGTH_DAYS = 4
SAMPLE_DAYS = 7
SAMPLE_SEED = 42
SAMPLE_DRAWS = 2
SAMPLE_SYSTEMS = 50
FINE_MINUTES = 5
BUCKETS = 8
QUANTILE_BINS = 10
QUANTILE_K = 65_535
ARRIVALS = 4
STREAM_SPAN = "4000 days"
FAR_AHEAD = "2300-01-01 00:00:00"
RAW_TREE = r"/y=(\d{4})/m=(\d{2})/[^/]*$"
GROWTH_YEAR = 1997
GROWTH_WINDOW = "7 days"


def _halfhour_tall(spark, sf_dir) -> DataFrame:
    """30-minute energy: readings to a wide day extract and back through P1."""
    wide = reshape.halfhour_slots_to_wide(fx.readings(spark, sf_dir))
    return reshape.wide_halfhour_to_tall(wide)


def q_activity_bounds(spark, sf_dir):
    return metadata.activity_bounds(fx.readings_long(spark, sf_dir))


def q_metadata_merge(spark, sf_dir):
    return metadata.merge_activity_bounds(fx.metadata_old(spark, sf_dir), fx.readings_new(spark, sf_dir))


def q_metadata_refresh(spark, sf_dir):
    return metadata.refresh_metadata(fx.metadata_raw(spark, sf_dir), fx.metadata_old(spark, sf_dir),
                                     fx.readings(spark, sf_dir))


def q_ids_missing(spark, sf_dir):
    return quality.ids_missing_from_metadata(fx.readings_long(spark, sf_dir), fx.metadata_raw(spark, sf_dir))


def q_id_overlap_counts(spark, sf_dir):
    return quality.id_overlap_counts(fx.readings_long(spark, sf_dir), fx.metadata_raw(spark, sf_dir))


def q_wide_to_tall(spark, sf_dir):
    return _halfhour_tall(spark, sf_dir)


def q_dedup_readings(spark, sf_dir):
    df = fx.readings_long(spark, sf_dir, extra=True)
    out = reshape.dedup(df, [SS_ID, TS], order_by=["l_orderkey", "l_linenumber"])
    return out.select(SS_ID, TS, GEN)


def q_resample_right_closed(spark, sf_dir):
    out = resample.resample_right_closed(fx.readings(spark, sf_dir), factor=60.0 / FINE_MINUTES,
                                         out="power_W")
    return out.withColumn("power_W", F.round("power_W", 6))


def q_compare_resolutions(spark, sf_dir):
    coarse = _halfhour_tall(spark, sf_dir).filter(F.col(GEN).isNotNull())
    out = resample.compare_resolutions(fx.readings(spark, sf_dir), coarse, fine_minutes=FINE_MINUTES)
    return out.withColumn("power_W", F.round("power_W", 6))


def q_capacity_outliers_lt(spark, sf_dir):
    return quality.capacity_outliers(fx.readings_long(spark, sf_dir), fx.capacity(spark, sf_dir), op="lt")


def q_capacity_outliers_gt(spark, sf_dir):
    return quality.capacity_outliers(fx.readings_long(spark, sf_dir), fx.capacity(spark, sf_dir), op="gt")


def q_compare_resolutions_day(spark, sf_dir):
    """P7 for one day, as the reference draws it, of every system."""
    coarse = _halfhour_tall(spark, sf_dir).filter(F.col(GEN).isNotNull())
    out = resample.compare_resolutions(fx.readings(spark, sf_dir), coarse, day=COMPARED_DAY,
                                       fine_minutes=FINE_MINUTES)
    return out.withColumn("power_W", F.round("power_W", 6))


def q_remove_implausible(spark, sf_dir):
    """Filter, rewrite the month layout, read it back with its keys."""
    kept = quality.remove_implausible(fx.readings_gaps(spark, sf_dir))
    root = _scratch(spark, "plausible")
    layout.write_sorted_months(kept, root)
    return scan_readings(spark, root, schema=_layout_schema(kept))


def q_exact_months(spark, sf_dir):
    return layout.repartition_exact_months(fx.readings_gaps(spark, sf_dir))


def q_exact_months_repair(spark, sf_dir):
    """P3 + P2 on a layout with misfiled rows: a third of the systems are
    filed one month late, and a few a year early; the repaired layout is
    read back with its keys."""
    readings = fx.readings_gaps(spark, sf_dir)
    filed = F.when(F.col(SS_ID) % 3 == 0, F.add_months(F.to_date(TS), 1)) \
        .when(F.col(SS_ID) % 50 == 1, F.add_months(F.to_date(TS), -12)).otherwise(F.to_date(TS))
    wrong = readings.withColumns({YEAR: F.year(filed).cast("smallint"), MONTH: F.month(filed).cast("tinyint")})
    before, after = _scratch(spark, "misfiled"), _scratch(spark, "repaired")
    layout.write_sorted_months(wrong, before, keep_keys=True)
    misfiled = scan_readings(spark, before, schema=_layout_schema(readings))
    layout.write_sorted_months(layout.repartition_exact_months(misfiled), after)
    return scan_readings(spark, after, schema=_layout_schema(readings))


def q_capacity_histogram(spark, sf_dir):
    return spatial.capacity_histogram(fx.metadata_raw(spark, sf_dir))


def q_capacity_quantile_bins(spark, sf_dir):
    """P12/A11 with edges from the data: ten bins between quantiles of a
    mergeable sketch (exact up to QUANTILE_K rows, see ``quantile_edges``)."""
    meta = fx.metadata_raw(spark, sf_dir)
    edges = spatial.quantile_edges(meta, bins=QUANTILE_BINS, k=QUANTILE_K)
    return spatial.capacity_histogram(meta, edges=edges).drop("bin_edges")


def q_hex_density(spark, sf_dir):
    return spatial.hex_density(fx.metadata_raw(spark, sf_dir))


def q_sphere_density(spark, sf_dir):
    """Systems per cell of the sphere at resolution 5, rolled up to 4 and 3."""
    return spatial.sphere_density(fx.metadata_raw(spark, sf_dir), 5, (4, 3))


def _sample_windows(spark, sf_dir):
    # The dataset's bounds are those of the systems' bounds: one scan of the readings.
    active = reliable_checkpoint(metadata.activity_bounds(fx.readings(spark, sf_dir)))
    bounds = active.agg(F.min(START), F.max(END))
    return sampling.sample_windows(active, bounds,
                                   days=SAMPLE_DAYS, seed=SAMPLE_SEED, draws=SAMPLE_DRAWS)


def q_sample_windows(spark, sf_dir):
    return _sample_windows(spark, sf_dir)


def q_sample_systems(spark, sf_dir):
    return sampling.sample_systems(fx.readings(spark, sf_dir), SAMPLE_SYSTEMS, SAMPLE_SEED)


def q_sample_fetch(spark, sf_dir):
    return sampling.fetch_windows(fx.readings(spark, sf_dir), _sample_windows(spark, sf_dir))


def q_outlier_context(spark, sf_dir):
    rd = fx.readings(spark, sf_dir)
    outliers = rd.filter(F.col(GEN) > F.lit(OUTLIER_CONTEXT_THRESHOLD))
    return sampling.outlier_context(rd, outliers, OUTLIER_CONTEXT_BEFORE_DAYS, OUTLIER_CONTEXT_LENGTH_DAYS)


def q_pivot_systems(spark, sf_dir):
    """The wide matrix of all systems, in blocks of 100 ids."""
    return pivot.pivot_blocks(_halfhour_tall(spark, sf_dir).filter(F.col(GEN).isNotNull()))


def q_pivot_map(spark, sf_dir):
    tall = _halfhour_tall(spark, sf_dir).filter(F.col(GEN).isNotNull())
    m = pivot.pivot_systems_map(tall)
    return m.select(TS, F.size("values").cast("bigint").alias("n_systems"),
                    F.explode("values").alias(SS_ID, GEN))


def q_max_excluding_point(spark, sf_dir):
    rl = fx.readings_long(spark, sf_dir)
    bad = rl.filter(F.col(GEN) >= F.lit(quality.IMPLAUSIBLE_WH))
    return quality.max_excluding_points(rl, bad)


def q_month_spine(spark, sf_dir):
    return months.month_spine(fx.readings_long(spark, sf_dir))


def q_largest_systems(spark, sf_dir):
    return metadata.largest_systems(fx.metadata_raw(spark, sf_dir), 10)


def q_latest_readings(spark, sf_dir):
    return peek.tail(fx.readings_long(spark, sf_dir), [TS, SS_ID, GEN], 5)


def q_earliest_readings(spark, sf_dir):
    return peek.head(fx.readings_long(spark, sf_dir), [TS, SS_ID, GEN], 5)


def q_readings_slice(spark, sf_dir):
    return peek.slice_rows(fx.readings_long(spark, sf_dir), [TS, SS_ID, GEN], SLICE_OFFSET, SLICE_LENGTH)


def q_exact_months_bounded(spark, sf_dir):
    return layout.repartition_exact_months(fx.readings_gaps(spark, sf_dir),
                                           start=EXACT_MONTHS_START, end=EXACT_MONTHS_END)


def q_outlier_context_row(spark, sf_dir):
    """P15 as the reference runs it: the system at row 7 of the outliers
    sorted by (ss_id, datetime_GMT) (O8), all of its outliers, and the
    readings from 100 days before the first one's day (hour set to 0), for
    200 days. Row 7 is taken as an ordered slice (a per-partition top 8),
    not from a full row index: the same row without a global sort."""
    rl = fx.readings_long(spark, sf_dir)
    outliers = quality.capacity_outliers(rl, fx.capacity(spark, sf_dir), op="gt", index=False)
    chosen = peek.slice_rows(outliers, [SS_ID, TS, GEN], OUTLIER_ROW, 1).select(SS_ID)
    return sampling.outlier_context(rl, outliers.join(chosen, SS_ID, "left_semi"),
                                    OUTLIER_ROW_BEFORE_DAYS, OUTLIER_ROW_LENGTH_DAYS)


def _scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint folder for a written layout."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_month_layout_roundtrip(spark, sf_dir):
    """P2 + S1: write readings as sorted month files, scan them back with typed keys."""
    readings = narrow_readings(fx.readings_long(spark, sf_dir))
    root = _scratch(spark, "month-layout")
    layout.write_sorted_months(readings, root)
    return scan_readings(spark, root, schema=_layout_schema(readings))


def _layout_schema(readings: DataFrame) -> T.StructType:
    """The readings' schema with typed Hive keys."""
    return T.StructType([f for f in readings.schema.fields if f.name not in (YEAR, MONTH)]
                        + PARTITIONED_READINGS.fields[-2:])


def q_layout_reads(spark, sf_dir):
    """The month layout read in four ways: one month by key equality
    under typed keys (S1), a time range with the key predicate (F13, X7)
    under inferred keys (S2), one folder (S3), and the distinct ids of a
    year's inferred keys."""
    readings = narrow_readings(fx.readings_long(spark, sf_dir))
    root = _scratch(spark, "month-reads")
    layout.write_sorted_months(readings, root)
    typed = scan_readings(spark, root, schema=_layout_schema(readings))
    inferred = scan_readings(spark, root, typed_keys=False)
    parts = {
        "month": typed.filter((F.col(YEAR) == READ_YEAR) & (F.col(MONTH) == READ_MONTH)),
        "range": sampling.with_month_pruning(inferred, RANGE_START, RANGE_END),
        "folder": scan_partition(spark, root, READ_YEAR, READ_MONTH, schema=_layout_schema(readings)),
        "ids": inferred.filter(F.col(YEAR) == READ_YEAR).select(SS_ID).distinct().withColumns(
            {TS: F.lit(None).cast("timestamp_ntz"), GEN: F.lit(None).cast("float")}),
    }
    frames = [df.select(F.lit(how).alias("how"), SS_ID, TS, GEN) for how, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def q_layout_overwrite_months(spark, sf_dir):
    """K1 + K2: the layout with one file per month, two of whose months are
    then replaced (readings halved); read back with keys."""
    readings = narrow_readings(fx.readings_long(spark, sf_dir))
    root = _scratch(spark, "month-overwrite")
    layout.write_sorted_months(readings, root, one_file=True)
    months_in = F.lit(False)
    for y, m in REPLACED_MONTHS:
        months_in = months_in | ((F.year(TS) == y) & (F.month(TS) == m))
    new = readings.filter(months_in).withColumn(GEN, (F.col(GEN) / 2).cast("float"))
    layout.write_sorted_months(new, root, mode="overwrite", one_file=True)
    return scan_readings(spark, root, schema=_layout_schema(readings))


def q_relayout_rewrite(spark, sf_dir):
    """P14 + P2: the raw path-encoded tree rewritten as the month layout
    under the paths' keys, and read back by them."""
    raw, root = _raw_tree(spark, sf_dir), _scratch(spark, "relaid")
    layout.write_sorted_months(_relaid(spark, raw), root, keep_keys=True)
    return scan_readings(spark, root, schema=_layout_schema(_relaid(spark, raw)))


def q_system_bounds(spark, sf_dir):
    """A1 of one reference system."""
    return metadata.dataset_bounds(fx.readings_long(spark, sf_dir), ss_id=REFERENCE_SYSTEM)


def q_metadata_sorted(spark, sf_dir):
    """O2: the merged metadata in its final order."""
    return metadata.sort_metadata(q_metadata_merge(spark, sf_dir))


def q_new_metadata_inferred(spark, sf_dir):
    """K6 + S7: the provider's extract written in Spark's default formats and
    read back with types inferred over the whole file."""
    root = _scratch(spark, "extract-csv")
    write_csv(fx.metadata_raw(spark, sf_dir), root)
    return read_new_metadata(spark, root, infer=True)


def _snapshots(spark, sf_dir):
    """A versioned table: all readings, then two of its months replaced (halved)."""
    readings = narrow_readings(fx.readings_long(spark, sf_dir))
    root = _scratch(spark, "snapshots")
    first = snapshots.write_snapshot(readings, root)
    months_in = F.lit(False)
    for y, m in REPLACED_MONTHS:
        months_in = months_in | ((F.col(YEAR) == y) & (F.col(MONTH) == m))
    new = first.readings().filter(months_in).withColumn(GEN, (F.col(GEN) / 2).cast("float"))
    return first, snapshots.write_snapshot(new, root)


def q_snapshot_versions(spark, sf_dir):
    """K2: both versions of the table, the older one read after the rewrite."""
    first, second = _snapshots(spark, sf_dir)
    return (first.readings().withColumn("version", F.lit(first.version))
            .unionByName(second.readings().withColumn("version", F.lit(second.version))))


def q_zone_map_fetch(spark, sf_dir):
    """Windows of all systems, from the files that the zone map of the
    rewritten table picks."""
    _, table = _snapshots(spark, sf_dir)
    active = reliable_checkpoint(metadata.activity_bounds(fx.readings_long(spark, sf_dir)))
    windows = reliable_checkpoint(sampling.sample_windows(active, active.agg(F.min(START), F.max(END)), days=SAMPLE_DAYS,
                                                          seed=SAMPLE_SEED, draws=SAMPLE_DRAWS))
    return table.fetch_windows(windows, materialize=False)


def q_bucketed_fetch(spark, sf_dir):
    """J7 beyond the broadcast bound: every order is a window of 30 days of
    the system of its customer, fetched from a bucketed table."""
    table, path = f"readings_{uuid.uuid4().hex}", _scratch(spark, "bucketed")
    bucketed.write_bucketed(fx.readings_long(spark, sf_dir), table, path, BUCKETS)
    start = F.col("o_orderdate").cast("timestamp_ntz")
    windows = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(SS_ID), start.alias("window_start"),
        (start + F.expr("INTERVAL 30 DAYS")).alias("window_end"))
    return bucketed.fetch_windows(spark, table, windows)


def _grown_table(spark, sf_dir, *kinds):
    """A table that grows, with aggregates kept up to date: the early years,
    then the later ones, then two early months once more (late readings are
    added to what was written of them first). Every version is updated."""
    readings = narrow_readings(fx.readings_long(spark, sf_dir))
    late = F.lit(False)
    for y, m in REPLACED_MONTHS:
        late = late | ((F.year(TS) == y) & (F.month(TS) == m))
    early = F.year(TS) < GROWTH_YEAR
    held_back = late & (F.dayofmonth(TS) > 10)
    root = _scratch(spark, "grown")
    for part in (readings.filter(early & ~held_back), readings.filter(~early & ~held_back), readings.filter(late)):
        table = snapshots.write_snapshot(part, root)
        for kind in kinds:
            derived.update(table, kind)
    return table


def q_incremental_id_counts(spark, sf_dir):
    """Distinct systems of every month, from bitmaps of month folders."""
    return derived.id_counts_by_month(_grown_table(spark, sf_dir, derived.ID_BITMAPS))


def q_incremental_id_overlap(spark, sf_dir):
    """Ids with readings and those with metadata, from bitmaps."""
    return derived.id_overlap_counts(_grown_table(spark, sf_dir, derived.ID_BITMAPS), fx.metadata_raw(spark, sf_dir))


def q_incremental_activity(spark, sf_dir):
    """A2: first and last reading of every system, from states of month folders."""
    return derived.merged(_grown_table(spark, sf_dir, derived.ACTIVITY), derived.ACTIVITY)


def q_incremental_resample(spark, sf_dir):
    """Weekly right-closed means, many of them across months, from
    sums and counts of month folders."""
    kind = derived.resample_sums(GROWTH_WINDOW)
    out = derived.merged(_grown_table(spark, sf_dir, kind), kind)
    return out.withColumn(GEN, F.round(GEN, 6))


def q_zone_map(spark, sf_dir):
    """The zone map against its files, as rows and bounds per month."""
    _, table = _snapshots(spark, sf_dir)
    return table.zones().groupBy(YEAR, MONTH).agg(
        F.sum("rows").alias("n_readings"), F.min("id_min").alias("id_min"), F.max("id_max").alias("id_max"),
        F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))


def q_rewrite_proof(spark, sf_dir):
    """P2 + P3 + P4 in one checked write of a month layout: NaN and
    implausible readings go, and the counts that prove that no other does."""
    readings = fx.readings_gaps(spark, sf_dir)
    before, after = _scratch(spark, "unchecked"), _scratch(spark, "checked")
    layout.write_sorted_months(readings, before)
    source = scan_readings(spark, before, schema=_layout_schema(readings))
    plausible = F.coalesce(F.col(GEN) < F.lit(float(quality.IMPLAUSIBLE_WH)), F.col(GEN).isNull())
    done = layout.rewrite_months(source, after, plausible)
    held = scan_readings(spark, after, schema=_layout_schema(readings)).groupBy(YEAR, MONTH).agg(
        F.count(F.lit(1)).alias("n_readings"), F.count(GEN).alias("n_values"))
    return held.withColumns({"rows_in": F.lit(done.rows_in).cast("bigint"), "dropped": F.lit(done.dropped).cast("bigint"),
                             "rows_out": F.lit(done.rows_out).cast("bigint")})


def q_metadata_rejects(spark, sf_dir):
    """S5-S7 with a reject channel: customers as metadata lines, some of them
    with a field that does not parse; lines per outcome and reason."""
    key = F.col("c_custkey")
    lines = fx.table(spark, sf_dir, "customer").select(
        F.when(key % 10 == 3, F.lit("unknown")).otherwise(key.cast("string")).alias(SS_ID),
        F.when(key % 10 == 5, F.lit("01/02/2020")).otherwise(F.lit("2020-02-01T00:00:00Z")).alias(START),
        F.lit("").alias(END), *[F.lit(1.5).alias(c) for c in METADATA_FLOAT_COLUMNS])
    raw = _scratch(spark, "metadata-lines")
    write_csv(lines, raw)
    good, rejected = read_with_rejects(spark, raw, _scratch(spark, "metadata-parsed"), METADATA, zone_less=True)
    return good.select(F.lit("good").alias("reason"), F.col(SS_ID).alias("id")).union(
        rejected.select("reason", F.lit(None).cast("bigint"))).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("id"), F.lit(0).cast("bigint")).alias("sum_ids"))


def _arrivals(df: DataFrame, name: str, schema: str, last: DataFrame | None = None) -> DataFrame:
    """The readings as files that arrive one after the other, as a stream;
    those of ``last`` after all others, as a stream takes files by age."""
    path = _scratch(df.sparkSession, name)
    aligned.as_instants(df).repartitionByRange(ARRIVALS, TS).write.parquet(path)
    if last is not None:
        aligned.as_instants(last).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream: DataFrame, name: str, schema: str) -> DataFrame:
    """What the stream has written when all files are taken, times zone-free."""
    spark, path = stream.sparkSession, _scratch(stream.sparkSession, name)
    aligned.append_to(stream, path, _scratch(spark, f"{name}-checkpoint")).awaitTermination()
    out = spark.read.schema(schema).parquet(path)
    return out.withColumn(TS, F.col(TS).cast("timestamp_ntz"))


def q_dedup_stream(spark, sf_dir):
    """A9 as a stream: the keys that a file stream with copies leaves. Files
    arrive in any order, so the watermark spans the data."""
    schema = f"{SS_ID} bigint, {TS} timestamp, {GEN} double"
    stream = aligned.dedup_stream(_arrivals(fx.readings_long(spark, sf_dir), "dedup-arrivals", schema), STREAM_SPAN)
    return _drained(stream, "dedup-stream", schema).select(SS_ID, TS)


def q_align_streams(spark, sf_dir):
    """J6 on streams: the fine series' half-hourly means against the coarse
    series. One reading far ahead on either side moves the watermark past all
    others, so that those without a partner come out."""
    rd = fx.readings(spark, sf_dir)
    means = resample.resample_right_closed(rd, factor=60.0 / FINE_MINUTES).select(
        SS_ID, TS, F.col(GEN).cast("double").alias(GEN))
    coarse = _halfhour_tall(spark, sf_dir).filter(F.col(GEN).isNotNull()).select(
        F.col(SS_ID).cast("bigint").alias(SS_ID), TS, F.col(GEN).cast("double").alias(GEN))
    schema = f"{SS_ID} bigint, {TS} timestamp, {GEN} double"
    ahead = spark.range(1).select(F.lit(-1).cast("bigint").alias(SS_ID),
                                  F.lit(FAR_AHEAD).cast("timestamp_ntz").alias(TS), F.lit(0.0).alias(GEN))
    sides = [_arrivals(df, name, schema, ahead) for df, name in ((means, "fine-arrivals"), (coarse, "coarse-arrivals"))]
    stream = aligned.align_streams(*sides, lateness=STREAM_SPAN, names=("mean_W", "coarse_Wh"))
    out = _drained(stream, "aligned", f"{SS_ID} bigint, {TS} timestamp, mean_W double, coarse_Wh double")
    return out.filter(F.col(SS_ID) >= 0).withColumn("mean_W", F.round("mean_W", 6))


def q_incremental_relayout(spark, sf_dir):
    """A raw tree that grows, laid out month by month as its files
    appear; the second refresh reads the new months only."""
    raw, root = _scratch(spark, "growing-tree"), _scratch(spark, "refreshed")
    readings = fx.readings_long(spark, sf_dir).withColumns({"y": F.date_format(TS, "yyyy"), "m": F.date_format(TS, "MM")})
    early = F.year(TS) < GROWTH_YEAR
    for part in (readings.filter(early), readings.filter(~early)):
        part.repartitionByRange("y", "m", SS_ID).write.mode("append").partitionBy("y", "m").parquet(raw)
        table = refresh.refresh(spark, root, f"{raw}/*/*/*.parquet", RAW_TREE)
    return table.readings()


def _raw_tree(spark, sf_dir) -> str:
    """Readings in a tree whose paths alone tell year and month.

    Range-partitioned on (month, system): a task writes a few neighbouring
    months, and a month holding a third of the rows is split over tasks."""
    raw = _scratch(spark, "raw-tree")
    (fx.readings_long(spark, sf_dir)
     .withColumns({"y": F.date_format(TS, "yyyy"), "m": F.date_format(TS, "MM")})
     .repartitionByRange("y", "m", SS_ID).write.partitionBy("y", "m").parquet(raw))
    return raw


def _relaid(spark, raw: str) -> DataFrame:
    return layout.relayout_by_path(spark, f"{raw}/*/*/*.parquet", pattern=RAW_TREE)


def q_relayout_months(spark, sf_dir):
    """P14 + S9: a raw tree that encodes year and month only in its paths,
    read back with the keys taken from each file's path; rows per month."""
    moved = _relaid(spark, _raw_tree(spark, sf_dir))
    return moved.groupBy(YEAR, MONTH).agg(F.count(F.lit(1)).alias("n_readings"),
                                          F.min(TS).alias("first_reading"), F.max(TS).alias("last_reading"))


def q_wide_months_roundtrip(spark, sf_dir):
    """K4 + S4/U6: the wide matrix written as month files, read back as one
    table under a declared schema that also lists a column no file has."""
    wide = q_pivot_systems(spark, sf_dir)
    root = _scratch(spark, "wide-months")
    pivot.write_wide_months(wide, root)
    return scan_wide_blocks(spark, f"{root}/year=*/month=*", [ABSENT_COLUMN], wide.schema[TS].dataType)


def q_metadata_csv_roundtrip(spark, sf_dir):
    """P8's result written as metadata.csv (K5) and read back."""
    root = _scratch(spark, "metadata-csv")
    write_metadata(q_metadata_merge(spark, sf_dir), root)
    return read_metadata(spark, root, zone_less=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "activity_bounds": q_activity_bounds,
    "metadata_merge": q_metadata_merge,
    "metadata_refresh": q_metadata_refresh,
    "ids_missing": q_ids_missing,
    "id_overlap_counts": q_id_overlap_counts,
    "wide_to_tall": q_wide_to_tall,
    "dedup_readings": q_dedup_readings,
    "resample_right_closed": q_resample_right_closed,
    "compare_resolutions": q_compare_resolutions,
    "capacity_outliers_lt": q_capacity_outliers_lt,
    "capacity_outliers_gt": q_capacity_outliers_gt,
    "compare_resolutions_day": q_compare_resolutions_day,
    "remove_implausible": q_remove_implausible,
    "exact_months": q_exact_months,
    "exact_months_repair": q_exact_months_repair,
    "capacity_histogram": q_capacity_histogram,
    "capacity_quantile_bins": q_capacity_quantile_bins,
    "hex_density": q_hex_density,
    "sphere_density": q_sphere_density,
    "sample_windows": q_sample_windows,
    "sample_systems": q_sample_systems,
    "sample_fetch": q_sample_fetch,
    "outlier_context": q_outlier_context,
    "pivot_systems": q_pivot_systems,
    "pivot_map": q_pivot_map,
    "max_excluding_point": q_max_excluding_point,
    "month_spine": q_month_spine,
    "largest_systems": q_largest_systems,
    "latest_readings": q_latest_readings,
    "month_layout_roundtrip": q_month_layout_roundtrip,
    "layout_reads": q_layout_reads,
    "layout_overwrite_months": q_layout_overwrite_months,
    "relayout_months": q_relayout_months,
    "relayout_rewrite": q_relayout_rewrite,
    "system_bounds": q_system_bounds,
    "metadata_sorted": q_metadata_sorted,
    "new_metadata_inferred": q_new_metadata_inferred,
    "earliest_readings": q_earliest_readings,
    "readings_slice": q_readings_slice,
    "exact_months_bounded": q_exact_months_bounded,
    "outlier_context_row": q_outlier_context_row,
    "wide_months_roundtrip": q_wide_months_roundtrip,
    "metadata_csv_roundtrip": q_metadata_csv_roundtrip,
    "metadata_rejects": q_metadata_rejects,
    "rewrite_proof": q_rewrite_proof,
    "align_streams": q_align_streams,
    "bucketed_fetch": q_bucketed_fetch,
    "dedup_stream": q_dedup_stream,
    "incremental_activity": q_incremental_activity,
    "incremental_id_counts": q_incremental_id_counts,
    "incremental_id_overlap": q_incremental_id_overlap,
    "incremental_relayout": q_incremental_relayout,
    "incremental_resample": q_incremental_resample,
    "snapshot_versions": q_snapshot_versions,
    "zone_map": q_zone_map,
    "zone_map_fetch": q_zone_map_fetch,
}
