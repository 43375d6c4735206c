import pytest
from pyspark.sql import functions as F

from conftest import T
from pvtide.operators import sampling, snapshots


def readings(spark, n=4000, systems=40, scale=1.0):
    """Half a year of readings of 40 systems, zone-free."""
    return spark.range(n).select(
        (F.col("id") % systems).cast("int").alias("ss_id"),
        (F.lit(T("2024-01-01")).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR") * F.col("id")).alias("datetime_GMT"),
        (F.col("id") * scale).cast("float").alias("generation_Wh"))


def rows(df):
    return sorted(map(tuple, df.select("ss_id", "datetime_GMT", "generation_Wh").collect()), key=str)


def month(df, m):
    return df.filter(F.month("datetime_GMT") == m)


def test_readers_see_old_or_new_months(spark, scratch):
    root = f"{scratch}/table"
    assert snapshots.open_snapshot(spark, root) is None
    first = snapshots.write_snapshot(readings(spark), root, num_partitions=12)
    assert first.version == 1 and first.n_rows == 4000 and rows(first.readings()) == rows(readings(spark))
    assert dict(first.readings().dtypes)["year"] == "smallint"
    held = first.readings()  # a reader that has begun
    second = snapshots.write_snapshot(month(readings(spark, scale=2.0), 2), root)
    expected = rows(month(readings(spark, scale=2.0), 2).union(readings(spark).filter(F.month("datetime_GMT") != 2)))
    assert rows(held) == rows(first.readings()) == rows(readings(spark))
    assert rows(second.readings()) == rows(snapshots.open_snapshot(spark, root).readings()) == expected
    assert rows(snapshots.open_snapshot(spark, root, 1).readings()) == rows(readings(spark))
    # Months that stay are the files of the version before.
    old = {z.file for z in first.zones().collect() if z.month != 2}
    assert old == {z.file for z in second.zones().collect() if z.month != 2}
    third = snapshots.write_snapshot(month(readings(spark), 3).limit(0), root, months=[(2024, 4)])
    assert third.version == 3 and rows(month(third.readings(), 4)) == [] and third.n_rows == second.n_rows - 720
    last = snapshots.write_snapshot(month(readings(spark), 1), root, replace_all=True)
    assert rows(last.readings()) == rows(month(readings(spark), 1))
    assert snapshots.versions(spark, root).count() == 4
    with pytest.raises(ValueError, match="no version 9"):
        snapshots.open_snapshot(spark, root, 9)
    with pytest.raises(ValueError, match="columns differ"):
        snapshots.write_snapshot(readings(spark).withColumn("more", F.lit(1)), root)


def test_failed_write_leaves_the_old_version(spark, scratch, monkeypatch):
    root = f"{scratch}/table"
    snapshots.write_snapshot(readings(spark), root)
    with pytest.raises(Exception, match="broken reading"):
        snapshots.write_snapshot(month(readings(spark), 2).withColumn(
            "generation_Wh", F.when(F.col("ss_id") == 3, F.raise_error(F.lit("broken reading")).cast("float"))
            .otherwise(F.lit(0).cast("float"))), root)

    def stopped(*args):
        raise RuntimeError("stopped before the pointer")

    publish = snapshots._publish
    monkeypatch.setattr(snapshots, "_publish", stopped)
    with pytest.raises(RuntimeError, match="before the pointer"):
        snapshots.write_snapshot(month(readings(spark, scale=3.0), 2), root)
    monkeypatch.setattr(snapshots, "_publish", publish)
    now = snapshots.open_snapshot(spark, root)
    assert now.version == 1 and rows(now.readings()) == rows(readings(spark))
    again = snapshots.write_snapshot(month(readings(spark, scale=3.0), 2), root)
    assert again.version == 2 and again.n_rows == 4000


def test_rows_that_get_lost_are_not_published(spark, scratch, monkeypatch):
    root = f"{scratch}/table"
    snapshots.write_snapshot(readings(spark), root)
    write = snapshots.layout.write_sorted_months

    def loses_a_file(df, path, **options):
        write(df, f"{path}-elsewhere", **options)
        spark.read.parquet(f"{path}-elsewhere").filter("ss_id <> 7").write.partitionBy("year", "month").parquet(path)

    monkeypatch.setattr(snapshots.layout, "write_sorted_months", loses_a_file)
    with pytest.raises(RuntimeError, match="not published"):
        snapshots.write_snapshot(month(readings(spark), 2), root)
    assert snapshots.open_snapshot(spark, root).version == 1


def test_of_two_writers_of_a_version_one_fails(spark, scratch):
    root = f"{scratch}/table"
    first = snapshots.write_snapshot(readings(spark), root)
    first.zones().write.parquet(f"{root}/manifests/00000002-a")
    first.zones().write.parquet(f"{root}/manifests/00000002-b")
    won = snapshots._publish(spark, root, 2, "00000002-a", first.columns)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots._publish(spark, root, 2, "00000002-b", first.columns)
    assert snapshots.open_snapshot(spark, root).name == won.name


def windows(spark, spans):
    return spark.createDataFrame([(i, T(a), T(b)) for i, a, b in spans],
                                 "ss_id int, window_start timestamp_ntz, window_end timestamp_ntz")


def test_zone_map_picks_the_files_of_a_fetch(spark, scratch):
    table = snapshots.write_snapshot(readings(spark), f"{scratch}/table", num_partitions=60)
    total = table.zones().count()
    assert total == table.n_files > 30
    wanted = windows(spark, [(3, "2024-02-01 05:00:00", "2024-02-08 05:00:00"), (39, "2024-01-28 00:00:00", "2024-02-03 00:00:00"),
                             (3, "2024-02-05 00:00:00", "2024-02-06 00:00:00"), (100, "2024-02-01 00:00:00", "2024-03-01 00:00:00"),
                             (5, "2030-01-01 00:00:00", "2030-01-02 00:00:00"), (6, "2024-03-02 00:00:00", "2024-03-01 00:00:00")])
    expected = sorted(map(tuple, readings(spark).join(wanted, "ss_id").filter("datetime_GMT between window_start and window_end")
                          .select("ss_id", "datetime_GMT", "generation_Wh", "window_start", "window_end").collect()))
    assert len(expected) > 5
    for literal in (False, True):
        got = table.fetch_windows(wanted, literal_windows=literal)
        assert sorted(map(tuple, got.collect())) == expected
        files = {f for f in got.inputFiles() if "/data/" in f}
        assert 0 < len(files) <= 8  # of more than 30: a window's systems lie in one or two files of a month
        assert {f.split("/table/")[1] for f in files} == set(table.files_for(wanted))
    nothing = table.fetch_windows(wanted.filter("ss_id = 100"), literal_windows=True)
    assert nothing.count() == 0 and table.files_for(wanted.limit(0)) == []
    assert table.fetch_windows(wanted.limit(0)).count() == 0


def test_zone_map_holds_the_bounds_of_every_file(spark, scratch):
    table = snapshots.write_snapshot(readings(spark), f"{scratch}/table", num_partitions=10)
    for z in table.zones().collect():
        own = table.scan([z.file]).agg(F.count("*"), F.min("ss_id"), F.max("ss_id"), F.min("datetime_GMT"), F.max("datetime_GMT"))
        assert tuple(own.first()) == (z["rows"], z.id_min, z.id_max, z.ts_min, z.ts_max)


def test_empty_tables_and_zoned_times(spark, scratch):
    empty = snapshots.write_snapshot(readings(spark).limit(0), f"{scratch}/empty")
    assert empty.n_files == 0 and empty.readings().count() == 0
    zoned = readings(spark).withColumn("datetime_GMT", F.col("datetime_GMT").cast("timestamp"))
    table = snapshots.write_snapshot(zoned, f"{scratch}/zoned", num_partitions=6)
    wanted = windows(spark, [(3, "2024-02-01 05:00:00", "2024-02-08 05:00:00")])
    expected = sampling.fetch_windows(zoned, wanted)
    for literal in (False, True):
        assert sorted(table.fetch_windows(wanted, literal_windows=literal).collect()) == sorted(expected.collect())
