import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import READINGS_DDL, T
from pvtide.operators.layout import write_sorted_months
from pvtide.operators.metadata import activity_bounds, dataset_bounds
from pvtide.operators import sampling
from pvtide.operators.sampling import (
    fetch_windows,
    outlier_context,
    sample_rows,
    sample_systems,
    sample_windows,
)
from pvtide.sources.readings import scan_readings


def _readings(spark, n_systems=5, days=40):
    n = n_systems * days * 48
    return spark.range(n).select(
        (F.col("id") % n_systems).cast("int").alias("ss_id"),
        (F.lit(T("2024-01-20")).cast("timestamp")
         + F.expr("INTERVAL 30 MINUTES") * F.floor(F.col("id") / n_systems)).alias("datetime_GMT"),
        (F.col("id") % 97).cast("float").alias("generation_Wh"))


def _brute(readings, windows):
    rows = readings.collect()
    out = []
    for w in windows.collect():
        for r in rows:
            if r.ss_id == w.ss_id and w.window_start <= r.datetime_GMT <= w.window_end:
                out.append((r.ss_id, r.datetime_GMT, r.generation_Wh, w.window_start, w.window_end))
    return sorted(out)


def test_windows_rules(spark):
    meta = spark.createDataFrame([
        (1, T("2024-01-01"), T("2024-03-01")),   # clipped at both ends
        (2, T("2024-02-01"), T("2024-02-05")),   # shorter than 7 days: dropped
        (3, T("2023-01-01"), T("2023-06-01")),   # outside the bounds: dropped
    ], "ss_id int, start_datetime_GMT timestamp, end_datetime_GMT timestamp")
    w = sample_windows(meta, (T("2024-01-10"), T("2024-02-20")), days=7, seed=42).collect()
    assert [r.ss_id for r in w] == [1]
    n = int((T("2024-02-20") - T("2024-01-10")).total_seconds() // 1800)
    k = int(hashlib.md5(b"1:0:42").hexdigest()[:15], 16) % n
    assert w[0].window_start == T("2024-01-10") + dt.timedelta(minutes=30 * k)
    assert w[0].window_end == w[0].window_start + dt.timedelta(days=7)
    full = sample_windows(meta, (T("2024-01-10"), T("2024-02-20")), full_only=True).first()
    assert full.window_end <= T("2024-02-20")


def test_fetch_matches_brute_force(spark):
    rd = _readings(spark)
    win = sample_windows(activity_bounds(rd), dataset_bounds(rd), days=7, seed=3)
    got = sorted(tuple(r) for r in fetch_windows(rd, win).collect())
    assert got == _brute(rd, win)
    assert len(got) == 5 * (7 * 48 + 1)


def test_fetch_without_broadcast_is_the_same(spark):
    rd = _readings(spark)
    win = sample_windows(activity_bounds(rd), dataset_bounds(rd), days=7, seed=3)
    q = fetch_windows(rd, win, max_broadcast_rows=2)
    assert "BroadcastExchange" not in q._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in q.collect()) == _brute(rd, win)


def test_fetch_on_month_layout_uses_dynamic_pruning(spark, scratch):
    rd = _readings(spark)
    root = f"{scratch}/30_minutely"
    write_sorted_months(rd, root)
    part = scan_readings(spark, root)
    win = spark.createDataFrame([(2, T("2024-01-30 10:00"), T("2024-02-02 10:00"))],
                                "ss_id int, window_start timestamp, window_end timestamp")
    q = fetch_windows(part, win)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan.lower()
    got = sorted(tuple(r) for r in q.collect())
    assert got == _brute(rd, win)
    assert {r[1].month for r in got} == {1, 2}


def test_sample_systems_reproducible(spark):
    ids = spark.range(1000).select(F.col("id").cast("int").alias("ss_id"))
    a = [r.ss_id for r in sample_systems(ids, 8, seed=1).collect()]
    b = [r.ss_id for r in sample_systems(ids, 8, seed=1).collect()]
    c = [r.ss_id for r in sample_systems(ids, 8, seed=2).collect()]
    assert a == b and len(set(a)) == 8 and a != c
    assert sample_systems(ids, None).count() == 1000
    rows = ids.withColumn("w", F.col("ss_id") * 2)
    assert [r.ss_id for r in sample_rows(rows, 8, seed=1).collect()] == a


def test_outlier_context(spark):
    rd = spark.createDataFrame([
        (1, T("2024-01-10 13:45"), 900.0), (1, T("2024-01-12 13:45"), 950.0),
        (1, T("2024-01-08 00:45"), 1.0), (1, T("2024-01-08 00:44"), 1.0), (1, T("2024-01-12 00:46"), 1.0),
    ], READINGS_DDL)
    out = outlier_context(rd, rd.filter("generation_Wh > 500"), before_days=2, length_days=4).collect()
    assert {r.window_start for r in out} == {T("2024-01-08 00:45")}
    assert sorted(r.datetime_GMT for r in out) == [T("2024-01-08 00:45"), T("2024-01-10 13:45")]


def test_windows_on_zone_less_data_ignore_session_zone(spark):
    rd = _readings(spark).withColumn("datetime_GMT", F.col("datetime_GMT").cast("timestamp_ntz"))

    def windows():
        return sorted(tuple(r) for r in sample_windows(activity_bounds(rd), dataset_bounds(rd), seed=5).collect())

    utc = windows()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = windows()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other and len(utc) == 5


def test_few_windows_push_ids_and_time_to_the_scan(spark, scratch):
    rd = _readings(spark, n_systems=20)
    root = f"{scratch}/30_minutely"
    write_sorted_months(rd, root)
    part = scan_readings(spark, root)
    win = spark.createDataFrame([(2, T("2024-01-30 10:00"), T("2024-02-02 10:00")),
                                 (7, T("2024-02-10 00:00"), T("2024-02-12 00:00"))],
                                "ss_id int, window_start timestamp, window_end timestamp")
    q = fetch_windows(part, win, literal_windows=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("], ")[0]
    assert "In(ss_id" in pushed and "GreaterThanOrEqual(datetime_GMT" in pushed
    assert sorted(tuple(r) for r in q.collect()) == _brute(rd, win)
    assert sorted(tuple(r) for r in fetch_windows(part, win, scan_filter=False).collect()) == _brute(rd, win)


def test_fetch_join_path_matches_brute_force(spark):
    rd = _readings(spark)
    win = sample_windows(activity_bounds(rd), dataset_bounds(rd), days=7, seed=3)
    got = sorted(tuple(r) for r in fetch_windows(rd, win).collect())
    assert got == _brute(rd, win)


def test_few_windows_prune_months_statically_and_keep_overlaps(spark, scratch):
    rd = _readings(spark, n_systems=20)
    root = f"{scratch}/30_minutely"
    write_sorted_months(rd, root)
    part = scan_readings(spark, root)
    # Two overlapping windows of one system: a reading in both appears twice.
    win = spark.createDataFrame([(2, T("2024-02-05 10:00"), T("2024-02-07 10:00")),
                                 (2, T("2024-02-06 10:00"), T("2024-02-08 10:00")),
                                 (9, T("2024-02-20 00:00"), T("2024-02-20 00:00")),
                                 (4, T("2024-02-08 00:00"), T("2024-02-01 00:00")),  # empty window
                                 (None, T("2024-02-05 10:00"), T("2024-02-07 10:00"))],  # no system
                                "ss_id int, window_start timestamp, window_end timestamp")
    q = fetch_windows(part, win, literal_windows=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Join" not in plan
    partition_filters = plan.split("PartitionFilters: [")[1].split("], ")[0]
    assert "make_date" in partition_filters
    got = sorted(tuple(r) for r in q.collect())
    assert got == _brute(rd, win)
    assert len(got) == 97 + 97 + 1
    empty = spark.createDataFrame([], "ss_id int, window_start timestamp, window_end timestamp")
    assert fetch_windows(part, empty).count() == 0
    assert fetch_windows(part, empty, literal_windows=True).count() == 0
    assert sorted(tuple(r) for r in fetch_windows(part, win).collect()) == got
    many = spark.range(sampling.MAX_LITERAL_WINDOWS + 1).select(
        F.col("id").cast("int").alias("ss_id"), F.lit(T("2024-02-05")).alias("window_start"),
        F.lit(T("2024-02-06")).alias("window_end"))
    with pytest.raises(ValueError):
        fetch_windows(part, many, literal_windows=True)


def test_window_bounds_are_exact_across_a_dst_change(spark):
    # The last reading is 01:30 UTC on 2023-10-29, the second 01:30 of that
    # night in London; as local text it would read back an hour earlier.
    rd = spark.range(0, 9 * 48 + 4).select(
        F.lit(1).cast("int").alias("ss_id"),
        (F.lit(T("2023-10-20 00:00")).cast("timestamp")
         + F.expr("INTERVAL 30 MINUTES") * F.col("id")).alias("datetime_GMT"),
        F.lit(1.0).cast("float").alias("generation_Wh"))

    def starts():
        w = sample_windows(activity_bounds(rd), dataset_bounds(rd), days=7, seed=11)
        return [r[0] for r in w.select(F.unix_micros("window_start")).collect()]

    utc = starts()
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        london = starts()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == london and len(utc) == 1


def test_shuffle_fetch_with_a_hot_system_matches_brute_force(spark):
    # System 0 holds a third of all readings and a third of the windows;
    # the windows side is over the broadcast bound, so the join shuffles.
    rd = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 20).cast("int")).alias("ss_id"),
        (F.lit(T("2024-01-01")).cast("timestamp") + F.expr("INTERVAL 10 MINUTES") * F.col("id")).alias("datetime_GMT"),
        (F.col("id") % 11).cast("float").alias("generation_Wh"))
    win = spark.range(30).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 20).cast("int")).alias("ss_id"),
        (F.lit(T("2024-01-02")).cast("timestamp") + F.expr("INTERVAL 1 DAY") * (F.col("id") % 50)).alias("window_start"))
    win = win.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 2 DAYS"))
    q = fetch_windows(rd, win, max_broadcast_rows=5)
    assert "BroadcastExchange" not in q._jdf.queryExecution().sparkPlan().toString()
    got = sorted(tuple(r) for r in q.collect())
    assert got == _brute(rd, win) and len(got) > 0


def test_literal_and_join_paths_agree_on_zone_less_month_layout(spark, scratch):
    rd = _readings(spark, n_systems=8).withColumn("datetime_GMT", F.col("datetime_GMT").cast("timestamp_ntz"))
    root = f"{scratch}/ntz_layout"
    write_sorted_months(rd, root)
    part = spark.read.parquet(root)
    win = sample_windows(activity_bounds(rd), dataset_bounds(rd), days=3, seed=9, full_only=True)
    literal = fetch_windows(part, win, literal_windows=True)
    assert "Join" not in literal._jdf.queryExecution().executedPlan().toString()
    few = sorted(tuple(r) for r in literal.collect())
    joined = sorted(tuple(r) for r in fetch_windows(part, win).collect())
    assert few == joined and len(few) == 8 * (3 * 48 + 1)


def test_flat_join_meets_only_windows_near_a_reading(spark):
    """On a flat table the join key has a time bucket: a reading of a system
    with many windows is not compared with all of them."""
    rd = _readings(spark, n_systems=2, days=60)
    win = spark.range(300).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(1).cast("int").alias("ss_id"),
        (F.lit(T("2024-01-20")).cast("timestamp") + F.expr("INTERVAL 4 HOURS") * F.col("id")).alias("window_start"))
    win = win.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 6 HOURS"))
    q = fetch_windows(rd, win, max_broadcast_rows=5)
    plan = q._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "_pvt_bucket" in join, join
    got = sorted(tuple(r) for r in q.collect())
    assert got == _brute(rd, win) and len(got) > 1000


def test_draws_are_unrelated_across_seeds_and_systems(spark):
    meta = spark.range(400).select(F.col("id").cast("int").alias("ss_id"),
                                   F.lit(T("2024-01-01")).alias("start_datetime_GMT"),
                                   F.lit(T("2024-12-31")).alias("end_datetime_GMT"))
    bounds = (T("2024-01-01"), T("2024-12-31"))

    def slots(seed, **options):
        rows = sample_windows(meta, bounds, days=7, seed=seed, **options).collect()
        return {(r.ss_id, r.draw): (r.window_start - T("2024-01-01")).total_seconds() / 1800 for r in rows}

    one, two = slots(1), slots(2)
    moved = [(two[k] - one[k]) % (364 * 48) for k in one]
    assert len(set(moved)) > 350  # a fixed shift would give one value
    x, y = list(one.values()), [two[k] for k in one]
    mx, my = sum(x) / 400, sum(y) / 400
    corr = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (
        sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert abs(corr) < 0.2
    several = slots(1, draws=3)
    assert len(several) == 1200 and all(several[k, 0] == one[k, 0] for k in range(400))
    some = slots(1, draws=3, n=50)
    assert len(some) == 50 and set(some.items()) <= set(several.items())
