import pytest
from pyspark.sql import functions as F

from conftest import READINGS_DDL, T
from pvtide.operators.pivot import map_to_tall, pivot_systems, pivot_systems_map, wide_to_tall
from pvtide.operators.resample import (
    SOURCE_COARSE,
    SOURCE_FINE,
    SOURCE_RESAMPLED,
    compare_resolutions,
    resample_right_closed,
)
from pvtide.operators.spatial import capacity_histogram


@pytest.fixture()
def tall(spark):
    return spark.createDataFrame([
        (3, T("2024-01-01 00:30"), 1.0), (1, T("2024-01-01 00:30"), 2.0), (1, T("2024-01-01 01:00"), 3.0),
        (20, T("2024-01-01 01:00"), None)], READINGS_DDL)


def test_pivot_numeric_order_and_roundtrip(tall):
    wide = pivot_systems(tall, [20, 3, 1])
    assert wide.columns == ["datetime_GMT", "1", "3", "20"]
    rows = {r.datetime_GMT: r for r in wide.collect()}
    assert rows[T("2024-01-01 00:30")]["3"] == 1.0 and rows[T("2024-01-01 00:30")]["20"] is None
    back = wide_to_tall(wide)
    assert sorted(tuple(r) for r in back.collect()) == sorted(
        (r.datetime_GMT, r.ss_id, r.generation_Wh) for r in tall.collect() if r.generation_Wh is not None)


def test_pivot_duplicates_raise(spark, tall):
    dup = tall.unionByName(spark.createDataFrame([(1, T("2024-01-01 00:30"), 9.0)], READINGS_DDL))
    with pytest.raises(Exception, match="duplicate"):
        pivot_systems(dup, [1, 3]).collect()
    with pytest.raises(Exception, match="(?i)duplicate"):
        pivot_systems_map(dup).collect()


def test_pivot_map_roundtrip(tall):
    m = pivot_systems_map(tall)
    back = map_to_tall(m)
    assert sorted(tuple(r) for r in back.collect()) == sorted(
        (r.datetime_GMT, r.ss_id, r.generation_Wh) for r in tall.collect())


def test_resample_right_closed_and_nan(spark):
    df = spark.createDataFrame([
        (1, T("2024-01-01 10:05"), 1.0), (1, T("2024-01-01 10:30"), 3.0),       # (10:00, 10:30]
        (1, T("2024-01-01 10:35"), float("nan")), (1, T("2024-01-01 10:40"), 1.0),
        (1, T("2024-01-01 11:05"), None), (1, T("2024-01-01 11:10"), 4.0)], READINGS_DDL)
    got = {r.datetime_GMT: r.generation_Wh for r in resample_right_closed(df).collect()}
    assert got[T("2024-01-01 10:30")] == 2.0
    assert got[T("2024-01-01 11:00")] != got[T("2024-01-01 11:00")]   # NaN propagates
    assert got[T("2024-01-01 11:30")] == 4.0                          # null skipped


def test_compare_resolutions_aligns_like_full_outer_join(spark):
    fine = spark.createDataFrame([
        (8, T("2024-01-10 05:55"), 1.0), (8, T("2024-01-10 06:00"), 2.0), (8, T("2024-01-10 06:05"), float("nan")),
        (8, T("2024-01-10 04:00"), 5.0)], READINGS_DDL)
    coarse = spark.createDataFrame([(8, T("2024-01-10 06:00"), 10.0), (8, T("2024-01-10 07:00"), None)], READINGS_DDL)
    out = compare_resolutions(fine, coarse, hours=(5, 21))
    rows = {(r.datetime_GMT, r.source): r.power_W for r in out.collect()}
    assert rows[(T("2024-01-10 06:00"), SOURCE_FINE)] == 24.0
    assert rows[(T("2024-01-10 06:00"), SOURCE_RESAMPLED)] == 18.0
    assert rows[(T("2024-01-10 06:00"), SOURCE_COARSE)] == 20.0
    # 05:55 exists only in the fine series: the other two are null rows.
    assert rows[(T("2024-01-10 05:55"), SOURCE_COARSE)] is None
    # NaN fine reading dropped, its resampled window (06:30) is NaN too -> dropped; coarse null kept.
    assert (T("2024-01-10 06:05"), SOURCE_FINE) not in rows
    assert (T("2024-01-10 06:30"), SOURCE_RESAMPLED) not in rows
    assert rows[(T("2024-01-10 07:00"), SOURCE_COARSE)] is None
    # 04:00 is outside 5..21 h
    assert not any(k[0] == T("2024-01-10 04:00") for k in rows)
    one_day = compare_resolutions(fine, coarse, day=T("2024-01-10").date())
    assert one_day.count() == out.count()
    assert compare_resolutions(fine, coarse, day=T("2024-01-11").date()).count() == 0


def test_histogram_edges(spark):
    vals = [0.0, 1.0, 1.5, 2.0, 4.0, 4.0001, 10.0, 250.0, 250.5, -1.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "kWp double")
    got = {r.bin_index: (r.bin_edges, r["count"]) for r in capacity_histogram(df).collect()}
    assert got[0] == ("[0.0, 1.0]", 2)
    assert got[1] == ("(1.0, 2.0]", 2)
    assert got[2] == ("(2.0, 3.0]", 0)
    assert got[3][1] == 1 and got[4] == ("(4.0, 10.0]", 2)
    assert got[9] == ("(200.0, 250.0]", 1)
    assert sum(c for _, c in got.values()) == 8 and len(got) == 10


def test_head_and_tail(spark):
    from pvtide.operators.peek import head, tail
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")).repartition(5)
    assert [r.a for r in head(df, ["a"], 3).collect()] == [0, 1, 2]
    assert [r.a for r in tail(df, ["a"], 3).collect()] == [97, 98, 99]
    assert [(r.b, r.a) for r in tail(df, ["b", "a"], 2).collect()] == [(6, 90), (6, 97)]


def test_write_wide_months_roundtrip(spark, scratch):
    import glob

    import pyarrow.parquet as pq

    from pvtide.operators.pivot import write_wide_months
    from pvtide.sources.readings import scan_wide
    tall = spark.createDataFrame([(1, T("2024-01-31 23:30"), 1.0), (2, T("2024-01-31 23:30"), 2.0),
                                  (1, T("2024-02-01 00:00"), 3.0), (2, T("2024-01-01 00:30"), 4.0)], READINGS_DDL)
    root = f"{scratch}/wide"
    write_wide_months(pivot_systems(tall, [1, 2]), root, one_file=True)
    files = sorted(glob.glob(f"{root}/year=2024/month=*/*.parquet"))
    assert [f.split("month=")[1][:2] for f in files] == ["01", "02"]
    times = pq.read_table(files[0]).column("datetime_GMT").to_pylist()
    assert times == sorted(times)
    back = scan_wide(spark, f"{root}/year=*/month=*", [1, 2, 3]).orderBy("datetime_GMT").collect()
    assert [tuple(r) for r in back] == [(T("2024-01-01 00:30"), None, 4.0, None),
                                        (T("2024-01-31 23:30"), 1.0, 2.0, None),
                                        (T("2024-02-01 00:00"), 3.0, None, None)]


def test_slice_rows(spark):
    from pvtide.operators.peek import slice_rows
    df = spark.range(100).select(F.col("id").alias("a")).repartition(6)
    assert [r.a for r in slice_rows(df, ["a"], 10, 4).collect()] == [10, 11, 12, 13]


def test_write_wide_months_split_by_time_range(spark, scratch):
    import glob

    import pyarrow.parquet as pq

    from pvtide.operators.pivot import write_wide_months
    from pvtide.sources.readings import scan_wide
    tall = spark.range(2 * 31 * 48).select(
        (F.col("id") % 2 + 1).cast("int").alias("ss_id"),
        (F.lit(T("2024-01-01 00:30")).cast("timestamp")
         + F.expr("INTERVAL 30 MINUTES") * F.floor(F.col("id") / 2)).alias("datetime_GMT"),
        F.col("id").cast("float").alias("generation_Wh"))
    wide = pivot_systems(tall, [1, 2])
    root = f"{scratch}/wide_split"
    write_wide_months(wide, root, one_file=False, num_partitions=4)
    files = sorted(glob.glob(f"{root}/year=2024/month=01/*.parquet"))
    assert len(files) > 1
    ranges = sorted((min(t), max(t)) for t in
                    (pq.read_table(f).column("datetime_GMT").to_pylist() for f in files))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    for f in files:
        times = pq.read_table(f).column("datetime_GMT").to_pylist()
        assert times == sorted(times)
    back = scan_wide(spark, f"{root}/year=*/month=*", [1, 2])
    assert back.count() == wide.count() == 31 * 48


def test_unpivot_series_and_sorted_metadata(spark):
    from pvtide.operators.metadata import sort_metadata
    from pvtide.operators.reshape import unpivot_series
    wide = spark.createDataFrame([(T("2024-01-01 00:30"), 1.0, 2, None)],
                                 "datetime_GMT timestamp, a double, b int, c float")
    long = unpivot_series(wide, ["datetime_GMT"], "source", "power_W").collect()
    assert [(r.source, r.power_W) for r in long] == [("a", 1.0), ("b", 2.0), ("c", None)]
    meta = spark.createDataFrame([(3,), (1,), (2,)], "ss_id bigint")
    assert [r.ss_id for r in sort_metadata(meta).collect()] == [1, 2, 3]


def test_block_pivot_has_no_cap(spark):
    """More ids than any column list would bear: the schema stays constant."""
    from pvtide.operators.pivot import blocks_to_tall, pivot_blocks

    n = 40_000
    tall = spark.range(n).select(F.col("id").cast("int").alias("ss_id"),
                                 F.lit(T("2024-05-01")).cast("timestamp").alias("datetime_GMT"),
                                 (F.col("id") % 1000).cast("float").alias("generation_Wh"))
    wide = pivot_blocks(tall)
    assert len(wide.columns) == 2 + 100 and wide.columns[2] == "c00" and wide.columns[-1] == "c99"
    assert wide.count() == n // 100
    row = wide.filter("id_block = 329").first()
    assert (row["c00"], row["c99"]) == (900.0, 999.0)
    back = blocks_to_tall(wide)
    assert back.count() == n and back.exceptAll(tall.select(*back.columns)).count() == 0


def test_block_pivot_matches_brute_force(spark, tall):
    from pvtide.operators.pivot import pivot_blocks
    from pvtide.schema import block_column

    wide = {(r.datetime_GMT, r.id_block): r for r in pivot_blocks(tall, width=8).collect()}
    rows = tall.collect()
    assert set(wide) == {(r.datetime_GMT, r.ss_id // 8) for r in rows}
    for (t, b), r in wide.items():
        cells = {x.ss_id: x.generation_Wh for x in rows if x.datetime_GMT == t and x.ss_id // 8 == b}
        assert {b * 8 + i: r[block_column(i, 8)] for i in range(8) if r[block_column(i, 8)] is not None} == {
            k: v for k, v in cells.items() if v is not None}


def test_block_pivot_duplicates_raise_before_gathering(spark, tall):
    from pvtide.operators.pivot import pivot_blocks, pivot_systems_map

    dup = tall.union(tall.limit(1))
    with pytest.raises(Exception, match="duplicate"):
        pivot_blocks(dup).collect()
    plan = pivot_systems_map(tall)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1  # copies combine before the shuffle


def test_comparison_reads_whole_windows_of_a_day(spark):
    """A window of two hours that ends at midnight takes all of its readings."""
    import datetime as dt

    rows = [(1, T("2024-01-09 22:30"), 100.0), (1, T("2024-01-09 23:30"), 200.0), (1, T("2024-01-10 00:00"), 300.0)]
    fine = spark.createDataFrame(rows, READINGS_DDL)
    coarse = fine.filter("generation_Wh > 250")
    options = {"hours": (0, 23), "fine_minutes": 60, "coarse_minutes": 120}
    pick = lambda df: sorted((r.source, r.power_W) for r in df.filter("datetime_GMT = '2024-01-10'").collect())
    whole = pick(compare_resolutions(fine, coarse, **options))
    assert pick(compare_resolutions(fine, coarse, day=dt.date(2024, 1, 10), **options)) == whole
    assert ("5 minutely resampled to 30 minutes", 200.0) in whole


def test_comparison_fails_on_a_second_reading_of_a_time(spark):
    fine = spark.createDataFrame([(1, T("2024-01-10 10:00"), 100.0), (1, T("2024-01-10 10:00"), 300.0)], READINGS_DDL)
    coarse = fine.limit(1)
    with pytest.raises(Exception, match="duplicate"):
        compare_resolutions(fine, coarse).collect()
    with pytest.raises(Exception, match="duplicate"):
        compare_resolutions(coarse, fine).collect()


def test_hex_density_has_no_cell_for_unknown_places(spark):
    from pvtide.operators.spatial import hex_density

    df = spark.createDataFrame([(51.0, -1.0), (float("nan"), -1.0), (51.0, float("nan")), (None, -1.0)],
                               "latitude_rounded double, longitude_rounded double")
    assert [r.n_systems for r in hex_density(df).collect()] == [1]


def test_wide_rows_are_aggregated_one_at_a_time(spark, tall):
    """No hash aggregate holds the wide rows (days or blocks) of all groups of a
    task, only narrow readings are shuffled, each once, and nothing is sorted twice."""
    from pvtide.operators.pivot import pivot_blocks
    from pvtide.operators.reshape import halfhour_slots_to_wide, wide_halfhour_to_tall

    days = wide_halfhour_to_tall(halfhour_slots_to_wide(tall))
    plan = pivot_blocks(days)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Sort [") == 2


def test_half_hours_to_blocks_with_nulls_and_repeats(spark):
    """Repeats in a half hour add up; null ids and times keep their rows."""
    from pvtide.operators.pivot import pivot_blocks
    from pvtide.operators.reshape import halfhour_slots_to_wide, wide_halfhour_to_tall

    rows = [(1, T("2024-01-09 10:05"), 1.0), (1, T("2024-01-09 10:10"), 2.0), (101, T("2024-01-09 10:10"), 4.0),
            (1, T("2024-01-09 10:40"), None), (None, T("2024-01-09 10:10"), 8.0), (2, None, 16.0)]
    days = wide_halfhour_to_tall(halfhour_slots_to_wide(spark.createDataFrame(rows, READINGS_DDL)))
    assert days.count() == 4 * 48
    found = pivot_blocks(days.filter("generation_Wh IS NOT NULL")).collect()
    cells = {(r.datetime_GMT, r.id_block): [v for v in list(r)[2:] if v is not None] for r in found}
    at = T("2024-01-09 10:30")
    assert cells == {(at, 0): [3.0], (at, 1): [4.0], (at, None): []}
    with pytest.raises(Exception, match="duplicate"):
        pivot_blocks(days.filter("ss_id = 1").union(days.filter("ss_id = 1"))).collect()


def test_wide_months_are_sorted_packed(spark, scratch, monkeypatch):
    """Rows are sorted with their filled cells alone and come back whole: nulls,
    NaN, more columns than one mask holds, columns of other types."""
    from pvtide.operators.pivot import write_wide_months

    names = [f"c{i:03d}" for i in range(130)]
    filled = {"empty": [], "edges": [0, 61, 62, 123, 124, 129], "all": range(130)}
    rows = [(T(f"2024-0{1 + n % 2}-0{1 + n} 00:30"), n, kind, *[(float("nan") if i == 62 else i - 0.5) if i in places else None for i in range(130)])
            for n, (kind, places) in enumerate(filled.items())]
    rows.append((None, None, None, *[None] * 129, 2.5))
    wide = spark.createDataFrame(rows, "datetime_GMT timestamp, id_block bigint, note string, " + ", ".join(f"{c} float" for c in names))
    widths, plain = [], type(wide).sortWithinPartitions

    def counted(self, *cols, **options):
        widths.append(len(self.columns))
        return plain(self, *cols, **options)

    monkeypatch.setattr(type(wide), "sortWithinPartitions", counted)
    for n, options in enumerate(({}, {"one_file": True}, {"num_partitions": 3})):
        write_wide_months(wide, f"{scratch}/{n}", **options)
        back = spark.read.schema(wide.schema).parquet(f"{scratch}/{n}/year=*/month=*")
        assert back.columns == wide.columns
        assert sorted(map(repr, back.collect())) == sorted(map(repr, wide.collect()))
    assert widths == [4 + 2 * 4] * 3  # keys, and a mask and an array for each of four packs
