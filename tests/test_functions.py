import math

from pyspark.sql import functions as F

from conftest import READINGS_DDL, T
from pvtide.functions import (
    add_minutes,
    drop_nans,
    half_hours_between,
    hex_cell,
    midnight_keep_minutes,
    month_dir_value,
    nan_max,
    right_closed_end,
)


def test_right_closed_end_edges(spark):
    df = spark.createDataFrame(
        [(T("2024-01-01 10:30:00"),), (T("2024-01-01 10:30:00.000001"),),
         (T("2024-01-01 10:00:00.000001"),), (T("2024-01-01 00:00:00"),)], "ts timestamp")
    got = [r[0] for r in df.select(right_closed_end("ts").alias("e")).collect()]
    # (10:00, 10:30] -> 10:30; 10:30 + 1us -> 11:00; midnight closes the previous day.
    assert got == [T("2024-01-01 10:30:00"), T("2024-01-01 11:00:00"),
                   T("2024-01-01 10:30:00"), T("2024-01-01 00:00:00")]


def test_right_closed_end_keeps_ntz(spark):
    df = spark.createDataFrame([(T("2024-01-01 10:15:00"),)], "ts timestamp_ntz")
    out = df.select(right_closed_end("ts").alias("e"))
    assert dict(out.dtypes)["e"] == "timestamp_ntz"


def test_drop_nans_keeps_null(spark):
    df = spark.createDataFrame([(1, T("2024-01-01"), float("nan")), (2, T("2024-01-01"), None),
                                (3, T("2024-01-01"), 1.0)], READINGS_DDL)
    assert sorted(r.ss_id for r in drop_nans(df).collect()) == [2, 3]


def test_nan_max_skips_nan(spark):
    df = spark.createDataFrame([(1, T("2024-01-01"), float("nan")), (1, T("2024-01-02"), 5.0),
                                (1, T("2024-01-03"), None)], READINGS_DDL)
    assert df.agg(nan_max("generation_Wh")).first()[0] == 5.0
    # Spark's own max would return NaN.
    assert math.isnan(df.agg(F.max("generation_Wh")).first()[0])


def test_midnight_keep_minutes_and_offsets(spark):
    df = spark.createDataFrame([(T("2024-03-05 13:45:10"),)], "ts timestamp")
    r = df.select(midnight_keep_minutes("ts").alias("m"), add_minutes("ts", 90).alias("a"),
                  month_dir_value("ts").alias("mm")).first()
    assert r.m == T("2024-03-05 00:45:10")
    assert r.a == T("2024-03-05 15:15:10")
    assert r.mm == "03"


def test_half_hours_between_truncates(spark):
    df = spark.createDataFrame([(T("2024-01-01 00:00:00.9"), T("2024-01-01 00:30:00.8")),
                                (T("2024-01-01 00:00:00"), T("2024-01-08 00:00:00"))], "s timestamp, e timestamp")
    assert [r[0] for r in df.select(half_hours_between("s", "e")).collect()] == [0, 336]


def test_hex_cell_neighbours_share_cells(spark):
    df = spark.createDataFrame([(51.50, -0.12), (51.5001, -0.1201), (55.95, -3.19)], "lat double, lon double")
    q, r = hex_cell(F.col("lat"), F.col("lon"))
    cells = [(x.q, x.r) for x in df.select(q.alias("q"), r.alias("r")).collect()]
    assert cells[0] == cells[1]
    assert cells[0] != cells[2]


def test_hex_cell_is_a_tiling(spark):
    # Every point belongs to the hexagon whose centre is nearest: check on a grid.
    pts = [(50 + i * 0.013, -6 + j * 0.021) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    q, r = hex_cell(F.col("lat"), F.col("lon"))
    rows = df.select("lat", "lon", q.alias("q"), r.alias("r")).collect()
    k = math.cos(math.radians(55.0)) * 111.32
    size = 9.85

    def centre(qq, rr):
        x = size * (math.sqrt(3) * qq + math.sqrt(3) / 2 * rr)
        y = size * 1.5 * rr
        return x, y

    for row in rows:
        x, y = row.lon * k, row.lat * 110.57
        cx, cy = centre(row.q, row.r)
        d_own = math.hypot(x - cx, y - cy)
        for dq, dr in [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]:
            nx, ny = centre(row.q + dq, row.r + dr)
            assert d_own <= math.hypot(x - nx, y - ny) + 1e-9


def test_durations_are_exact_for_instants_in_any_zone(spark):
    from pvtide.functions.timecols import add_days, add_minutes, micros_between
    df = spark.sql("select timestamp_micros(1697760000000000) as a, timestamp_micros(1698543000000000) as b")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        r = df.select(micros_between("a", "b", "timestamp").alias("d"),
                      F.unix_micros(add_days("a", 10, "timestamp")).alias("a10"),
                      F.unix_micros(add_minutes("a", 14400, "timestamp")).alias("am")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r.d == 1698543000000000 - 1697760000000000
    assert r.a10 == r.am == 1697760000000000 + 10 * 86_400_000_000
