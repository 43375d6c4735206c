import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import READINGS_DDL, T
from pvtide.operators.layout import relayout_by_path, repartition_exact_months, write_sorted_months
from pvtide.operators.sampling import with_month_pruning
from pvtide.sources.readings import scan_partition, scan_readings, scan_wide


def _readings(spark, n=3000):
    # 3 systems, readings every 7 hours for ~2.4 years, one NaN, one null.
    df = spark.range(n).select(
        (F.col("id") % 3).cast("int").alias("ss_id"),
        (F.lit(T("2022-11-15")).cast("timestamp") + F.expr("INTERVAL 7 HOURS") * F.col("id")).alias("datetime_GMT"),
        F.when(F.col("id") == 5, F.lit(float("nan"))).when(F.col("id") == 6, F.lit(None))
        .otherwise(F.col("id").cast("float")).cast("float").alias("generation_Wh"))
    return df


def _files(root):
    return sorted(glob.glob(f"{root}/year=*/month=*/*.parquet"))


def test_sorted_month_layout_roundtrip(spark, scratch):
    df = _readings(spark)
    root = f"{scratch}/30_minutely"
    write_sorted_months(df, root, num_partitions=5)
    files = _files(root)
    assert files and all("/month=" in f and len(f.split("/month=")[1].split("/")[0]) == 2 for f in files)
    for f in files:
        t = pq.read_table(f)
        keys = list(zip(t.column("ss_id").to_pylist(), t.column("datetime_GMT").to_pylist()))
        assert keys == sorted(keys), f
        # timestamps carry statistics (not INT96)
        assert pq.ParquetFile(f).metadata.row_group(0).column(1).statistics.has_min_max
        y, m = f.split("year=")[1].split("/month=")
        months = {(ts.year, ts.month) for ts in t.column("datetime_GMT").to_pylist()}
        assert months == {(int(y), int(m.split("/")[0]))}
    back = scan_readings(spark, root)
    assert dict(back.dtypes)["year"] == "smallint" and dict(back.dtypes)["month"] == "tinyint"
    assert back.count() == df.count()
    assert back.drop("year", "month").exceptAll(df).count() == 0


def test_one_file_per_month(spark, scratch):
    root = f"{scratch}/one"
    write_sorted_months(_readings(spark, 500), root, one_file=True)
    dirs = {os.path.dirname(f) for f in _files(root)}
    assert len(_files(root)) == len(dirs)


def test_exact_months_moves_misfiled_rows(spark, scratch):
    df = spark.createDataFrame([
        (1, T("2024-02-01 00:00:00"), 1.0, 2024, 1),   # t48 of Jan 31, filed in January
        (1, T("2024-04-10 12:00:00"), 2.0, 2024, 2),   # two months away
        (1, T("2024-02-10 12:00:00"), float("nan"), 2024, 2),
        (1, T("2024-02-11 12:00:00"), None, 2024, 2),
    ], READINGS_DDL + ", year smallint, month tinyint")
    out = {(r.datetime_GMT, r.year, r.month) for r in repartition_exact_months(df).collect()}
    assert out == {(T("2024-02-01 00:00:00"), 2024, 2), (T("2024-04-10 12:00:00"), 2024, 4),
                   (T("2024-02-11 12:00:00"), 2024, 2)}
    bounded = repartition_exact_months(df, start=T("2024-02-01"), end=T("2024-03-01"))
    assert bounded.count() == 2


def test_month_pruning_in_plan(spark, scratch):
    root = f"{scratch}/pruned"
    write_sorted_months(_readings(spark), root)
    df = scan_readings(spark, root)
    q = with_month_pruning(df, T("2023-03-05"), T("2023-04-02")).filter(F.col("ss_id") == 1)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "make_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters" in plan and "datetime_GMT" in plan.split("PushedFilters")[1]
    rows = q.collect()
    assert rows and all(T("2023-03-05") <= r.datetime_GMT <= T("2023-04-02") for r in rows)
    part = scan_partition(spark, root, 2023, 3)
    assert {(r.year, r.month) for r in part.select("year", "month").distinct().collect()} == {(2023, 3)}


def test_relayout_by_path(spark, scratch):
    raw = f"{scratch}/raw"
    df = _readings(spark, 400)
    for (y, m) in [(2022, 11), (2022, 12), (2023, 1)]:
        part = df.filter((F.year("datetime_GMT") == y) & (F.month("datetime_GMT") == m))
        part.write.parquet(f"{raw}/{y}/{m:02d}")
    out = relayout_by_path(spark, f"{raw}/*/*/*.parquet")
    got = {(r.year, r.month) for r in out.select("year", "month").distinct().collect()}
    assert got == {(2022, 11), (2022, 12), (2023, 1)}
    assert out.filter(F.month("datetime_GMT") != F.col("month")).count() == 0


def test_scan_wide_missing_columns(spark, scratch):
    a = spark.createDataFrame([(T("2024-01-01 00:30"), 1.0, 2.0)], "datetime_GMT timestamp, `1` float, `2` float")
    b = spark.createDataFrame([(T("2024-02-01 00:30"), 3.0, 9.0)], "datetime_GMT timestamp, `1` float, `9` float")
    a.write.parquet(f"{scratch}/w/a")
    b.write.parquet(f"{scratch}/w/b")
    out = scan_wide(spark, [f"{scratch}/w/a", f"{scratch}/w/b"], [1, 2]).orderBy("datetime_GMT").collect()
    assert [tuple(r) for r in out] == [(T("2024-01-01 00:30"), 1.0, 2.0), (T("2024-02-01 00:30"), 3.0, None)]


def test_dynamic_overwrite_replaces_only_touched_months(spark, scratch):
    root = f"{scratch}/dyn"
    df = _readings(spark, 600)
    write_sorted_months(df, root)
    before = scan_readings(spark, root)
    n_total = before.count()
    months = {(r.year, r.month) for r in before.select("year", "month").distinct().collect()}
    # Rewrite one month (from a different source) with only its first 3 rows.
    one = df.filter((F.year("datetime_GMT") == 2022) & (F.month("datetime_GMT") == 12))
    n_dec = one.count()
    write_sorted_months(one.orderBy("datetime_GMT").limit(3), root, mode="overwrite")
    after = scan_readings(spark, root)
    assert {(r.year, r.month) for r in after.select("year", "month").distinct().collect()} == months
    assert after.count() == n_total - n_dec + 3


def test_new_metadata_inference(spark, scratch):
    from pvtide.sources.csvfiles import read_new_metadata
    path = f"{scratch}/new_metadata.csv"
    with open(path, "w") as f:
        f.write("ss_id,owner_id,owner_name,system_id,latitude_rounded,longitude_rounded,orientation,tilt,kWp\n")
        f.write("1,,A,s1,51.5,-1.25,180,30,4.0\n2,,B,s2,52.5,-2.25,90,10,\n")
    inferred = read_new_metadata(spark, path, infer=True)
    types = dict(inferred.dtypes)
    assert types["ss_id"] == "int" and types["owner_id"] == "string" and types["kWp"] == "double"
    declared = read_new_metadata(spark, path)
    assert dict(declared.dtypes)["ss_id"] == "bigint"
    assert declared.filter("kWp is null").count() == 1


def test_hot_system_is_split_across_tasks(spark):
    from pvtide.operators.indexing import with_row_index
    from pvtide.operators.layout import sorted_month_frame
    # System 0 holds a third of all rows, all in one month.
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 500).cast("int")).alias("ss_id"),
        (F.lit(T("2024-05-01")).cast("timestamp") + F.expr("INTERVAL 1 MINUTE") * F.col("id")).alias("datetime_GMT"),
        F.lit(1.0).cast("float").alias("generation_Wh"))
    hot = hot.filter(F.month("datetime_GMT") == 5)
    sizes = [r[1] for r in sorted_month_frame(hot, num_partitions=8)
             .groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.25 * sum(sizes)
    # AQE would merge this small input into one partition; look at the ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        idx = with_row_index(hot, ["ss_id", "datetime_GMT"])
        parts = [r[1] for r in idx.groupBy(F.spark_partition_id()).count().collect()]
        ids = sorted(r["index"] for r in idx.select("index").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(parts) < 0.3 * sum(parts)  # the hot third is split
    assert ids == list(range(len(ids)))


def test_scan_nanosecond_timestamps(spark, scratch):
    import datetime as dt

    import pyarrow as pa

    from pvtide.sources.readings import scan_nanos
    ns = [1_704_069_000_000_000_000, 1_704_070_800_123_456_789, -501]  # last: 1969-12-31 23:59:59.999999499
    t = pa.table({"ss_id": pa.array([1, 2, 3], pa.int32()),
                  "datetime_GMT": pa.array(ns, pa.timestamp("ns", tz="UTC")),
                  "generation_Wh": pa.array([1.5, 2.5, 3.5], pa.float32())})
    pq.write_table(t, f"{scratch}/ns.parquet")
    got = scan_nanos(spark, f"{scratch}/ns.parquet").orderBy("ss_id").collect()
    assert [r.datetime_GMT for r in got] == [T("2024-01-01 00:30:00"), T("2024-01-01 01:00:00.123456"),
                                             T("1969-12-31 23:59:59.999999")]
    ntz = scan_nanos(spark, f"{scratch}/ns.parquet", zone_less=True)
    assert dict(ntz.dtypes)["datetime_GMT"] == "timestamp_ntz"
    assert ntz.orderBy("ss_id").first().datetime_GMT == dt.datetime(2024, 1, 1, 0, 30)


def test_inferred_keys_scan_and_positional_access(spark, scratch):
    from pvtide.operators.indexing import nth, with_row_index
    df = _readings(spark, 400)
    root = f"{scratch}/inferred"
    write_sorted_months(df, root)
    back = scan_readings(spark, root, typed_keys=False)
    assert dict(back.dtypes)["year"] == "int" and dict(back.dtypes)["month"] == "int"
    assert back.count() == 400
    idx = with_row_index(back.drop("year", "month"), ["ss_id", "datetime_GMT"])
    expected = sorted((r.ss_id, r.datetime_GMT) for r in df.collect())
    for i in (0, 123, 399):
        row = nth(idx, i).collect()
        assert len(row) == 1 and (row[0].ss_id, row[0].datetime_GMT) == expected[i]
    assert nth(idx, 400).count() == 0


def test_row_index_splits_identical_copies(spark, scratch):
    from pvtide.operators.indexing import with_row_index
    # A third of all rows are copies of one reading.
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id").cast("int")).alias("ss_id"),
        F.when(F.col("id") % 3 == 0, F.lit(T("2024-05-01"))).otherwise(
            F.lit(T("2024-05-01")) + F.expr("INTERVAL 1 MINUTE") * F.col("id")).cast("timestamp").alias("datetime_GMT"),
        F.lit(1.0).cast("float").alias("generation_Wh")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        idx = with_row_index(df, ["ss_id", "datetime_GMT", "generation_Wh"], path=f"{scratch}/index")
        files = spark.read.parquet(f"{scratch}/index").select("_metadata.file_name")
        parts = [r[1] for r in files.groupBy("file_name").count().collect()]
        rows = sorted((r["index"], r.ss_id, r.datetime_GMT) for r in idx.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(parts) < 0.3 * sum(parts)
    expected = sorted((r.ss_id, r.datetime_GMT) for r in df.collect())
    assert [r[0] for r in rows] == list(range(30000))
    assert [(r[1], r[2]) for r in rows] == expected


def test_row_group_size_option(spark, scratch):
    root = f"{scratch}/small_groups"
    df = spark.range(200000).select(
        (F.col("id") % 50).cast("int").alias("ss_id"),
        (F.lit(T("2024-05-01")).cast("timestamp") + F.expr("INTERVAL 1 SECOND") * F.col("id")).alias("datetime_GMT"),
        F.rand(1).cast("float").alias("generation_Wh"))
    write_sorted_months(df, root, num_partitions=1, row_group_bytes=256 * 1024)
    files = _files(root)
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1
    assert scan_readings(spark, root).count() == 200000


def test_exact_months_layout_is_idempotent(spark, scratch):
    df = _readings(spark, 1200)
    first = f"{scratch}/first"
    write_sorted_months(repartition_exact_months(df), first, num_partitions=4)
    again = f"{scratch}/again"
    write_sorted_months(repartition_exact_months(scan_readings(spark, first)), again, num_partitions=4)
    a, b = scan_readings(spark, first), scan_readings(spark, again)
    assert a.count() == b.count() == df.filter(~F.isnan("generation_Wh") | F.col("generation_Wh").isNull()).count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    for f in _files(again):
        t = pq.read_table(f)
        keys = list(zip(t.column("ss_id").to_pylist(), t.column("datetime_GMT").to_pylist()))
        assert keys == sorted(keys)
        y, m = f.split("year=")[1].split("/month=")
        assert {(ts.year, ts.month) for ts in t.column("datetime_GMT").to_pylist()} == {(int(y), int(m[:2]))}


def _year_end(spark):
    """What slot 48 of 31 December gives: a reading of 2024 filed under 2023/12."""
    return spark.createDataFrame([(1, T("2023-12-31 23:30"), 1.0, 2023, 12), (1, T("2024-01-01 00:00"), 2.0, 2023, 12)],
                                 READINGS_DDL + ", year smallint, month tinyint")


def test_keys_have_one_source(spark, scratch):
    import glob

    from pvtide.operators.sampling import fetch_windows

    win = spark.createDataFrame([(1, T("2023-12-31"), T("2024-01-02"))],
                                "ss_id int, window_start timestamp, window_end timestamp")
    frame = _year_end(spark)
    write_sorted_months(frame, f"{scratch}/time")
    assert sorted(p.split("time/")[1] for p in glob.glob(f"{scratch}/time/*/*")) == [
        "year=2023/month=12", "year=2024/month=01"]
    by_time = scan_readings(spark, f"{scratch}/time")
    for literal in (False, True):
        assert fetch_windows(by_time, win, literal_windows=literal).count() == 2
    assert with_month_pruning(by_time, T("2023-12-31"), T("2024-01-02")).count() == 2

    write_sorted_months(frame, f"{scratch}/kept", keep_keys=True)
    assert [p.split("kept/")[1] for p in glob.glob(f"{scratch}/kept/*/*")] == ["year=2023/month=12"]
    kept = scan_readings(spark, f"{scratch}/kept")
    write_sorted_months(repartition_exact_months(kept), f"{scratch}/repaired")
    assert fetch_windows(scan_readings(spark, f"{scratch}/repaired"), win).count() == 2
    write_sorted_months(kept, f"{scratch}/rewritten")  # a frame that carries keys, rewritten as it comes
    assert fetch_windows(scan_readings(spark, f"{scratch}/rewritten"), win).count() == 2


def test_keep_keys_needs_keys_and_pads_months(spark, scratch):
    import glob

    import pytest

    with pytest.raises(ValueError):
        write_sorted_months(_readings(spark), f"{scratch}/none", keep_keys=True)
    one = spark.createDataFrame([(1, T("2024-07-01"), 1.0, 2020, 3)], READINGS_DDL + ", year smallint, month tinyint")
    write_sorted_months(one, f"{scratch}/padded", keep_keys=True)
    assert glob.glob(f"{scratch}/padded/year=2020/month=03/*.parquet")


def test_relayout_then_fetch_loses_nothing(spark, scratch):
    from pvtide.operators.sampling import fetch_windows

    _year_end(spark).select("ss_id", "datetime_GMT", "generation_Wh").coalesce(1).write.parquet(f"{scratch}/raw/2023/12")
    moved = relayout_by_path(spark, f"{scratch}/raw/*/*/*.parquet")
    write_sorted_months(moved, f"{scratch}/months")
    win = spark.createDataFrame([(1, T("2023-12-31"), T("2024-01-02"))],
                                "ss_id int, window_start timestamp, window_end timestamp")
    assert fetch_windows(scan_readings(spark, f"{scratch}/months"), win).count() == 2


def test_writers_leave_the_session_as_it_is(spark, scratch):
    import pytest

    key = "spark.sql.parquet.outputTimestampType"
    spark.conf.set(key, "INT96")
    try:
        with pytest.raises(ValueError):
            write_sorted_months(_readings(spark), f"{scratch}/int96")
        assert spark.conf.get(key) == "INT96"
    finally:
        spark.conf.set(key, "TIMESTAMP_MICROS")


def test_range_count_follows_the_size_of_the_files(spark, scratch, monkeypatch):
    from pvtide.operators import layout

    write_sorted_months(_readings(spark), f"{scratch}/in")
    df = scan_readings(spark, f"{scratch}/in")
    assert layout.estimated_partitions(df) is None
    monkeypatch.setattr(layout, "RANGE_BYTES", 100)
    assert layout.estimated_partitions(df.join(df.select("ss_id").distinct(), "ss_id")) > 10
    assert layout.estimated_partitions(spark.createDataFrame([(1,)], "a int")) is None


def test_late_slice_reads_the_row_index(spark):
    from pvtide.operators.peek import slice_rows

    df = spark.range(2000).select((F.col("id") * 37 % 2000).cast("int").alias("ss_id"), (F.col("id") % 5).alias("v"))
    got = [r.ss_id for r in slice_rows(df, ["ss_id"], 1500, 7, top_rows=100).orderBy("ss_id").collect()]
    assert got == list(range(1500, 1507))
    plan = slice_rows(df, ["ss_id"], 1500, 7, top_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_rewrite_proves_that_no_row_is_lost(spark, scratch, monkeypatch):
    """P4 and P3 as one write that counts what reaches it and what it drops."""
    import pytest
    from pvtide.functions.nan import not_nan
    from pvtide.operators import layout

    write_sorted_months(_readings(spark), f"{scratch}/in")
    source = scan_readings(spark, f"{scratch}/in")
    done = layout.rewrite_months(source, f"{scratch}/out", not_nan("generation_Wh") & (F.col("ss_id") != 2))
    expected = _readings(spark).filter(not_nan("generation_Wh") & (F.col("ss_id") != 2))
    assert (done.rows_in, done.dropped, done.rows_out) == (3000, 3000 - expected.count(), expected.count())
    assert scan_readings(spark, f"{scratch}/out").drop("year", "month").exceptAll(expected).count() == 0
    assert done.checksum == expected.agg(layout.key_checksum()).first()[0]
    # An arrangement that loses rows does not pass.
    arrange = layout.sorted_month_frame
    monkeypatch.setattr(layout, "sorted_month_frame", lambda df, *a, **k: arrange(df, *a, **k).filter("ss_id <> 1"))
    with pytest.raises(RuntimeError, match="reached the writer"):
        layout.rewrite_months(source, f"{scratch}/lossy", F.lit(True))
