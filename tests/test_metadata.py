import pytest

from conftest import T
from pvtide.operators.metadata import (
    activity_bounds,
    largest_systems,
    merge_activity_bounds,
    refresh_metadata,
)
from pvtide.schema import METADATA, METADATA_COLUMNS
from pvtide.sources.csvfiles import read_metadata, write_csv, write_metadata

META_DDL = METADATA


@pytest.fixture()
def meta(spark):
    return spark.createDataFrame([
        (1, T("2020-01-01"), T("2024-01-01"), 51.0, -1.0, 180.0, 30.0, 4.0),   # new end later
        (2, T("2020-01-01"), T("2024-06-01"), 52.0, -2.0, 180.0, 30.0, 3.0),   # new end earlier
        (3, T("2020-06-01"), T("2024-01-01"), 53.0, -3.0, 180.0, 30.0, None),  # new start earlier
        (4, None, None, 54.0, -4.0, 90.0, 10.0, 2.0),                          # no bounds yet
        (5, T("2020-01-01"), T("2021-01-01"), 55.0, -5.0, 90.0, 10.0, 1.0),    # no new readings
    ], META_DDL)


@pytest.fixture()
def new_readings(spark):
    return spark.createDataFrame([
        (1, T("2024-03-01"), 1.0), (1, T("2024-03-31"), 1.0),
        (2, T("2024-03-01"), 1.0),
        (3, T("2019-01-01"), 1.0), (3, T("2024-03-01"), 1.0),
        (4, T("2024-03-02"), 1.0), (4, T("2024-03-03"), 1.0),
        (99, T("2024-03-02"), 1.0),  # not in metadata: not added
    ], "ss_id int, datetime_GMT timestamp, generation_Wh float")


def test_activity_bounds(new_readings):
    got = {r.ss_id: (r.start_datetime_GMT, r.end_datetime_GMT) for r in activity_bounds(new_readings).collect()}
    assert got[1] == (T("2024-03-01"), T("2024-03-31"))
    assert len(got) == 5


def test_merge_rules(meta, new_readings):
    out = {r.ss_id: r for r in merge_activity_bounds(meta, new_readings).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert out[1].end_datetime_GMT == T("2024-03-31")
    assert out[2].end_datetime_GMT == T("2024-06-01")          # never moved earlier
    assert out[3].start_datetime_GMT == T("2020-06-01")        # start only filled when missing
    assert out[4].start_datetime_GMT == T("2024-03-02") and out[4].end_datetime_GMT == T("2024-03-03")
    assert out[5].end_datetime_GMT == T("2021-01-01")
    assert list(merge_activity_bounds(meta, new_readings).columns) == METADATA_COLUMNS


def test_refresh_keeps_ids_with_data(spark, meta, new_readings):
    extract = spark.createDataFrame([
        (1, "o1", "Owner", "s1", 51.1, -1.1, 170.0, 35.0, 4.5),
        (2, "o2", "Owner", "s2", 52.1, -2.1, 170.0, 35.0, 3.5),
        (7, "o7", "Owner", "s7", 57.1, -7.1, 170.0, 35.0, 9.5),   # no readings: dropped
        (99, "o9", "Owner", "s9", 59.1, -9.1, 170.0, 35.0, 1.5),  # readings, no old bounds
    ], "ss_id bigint, owner_id string, owner_name string, system_id string, latitude_rounded double, "
       "longitude_rounded double, orientation double, tilt double, kWp double")
    out = refresh_metadata(extract, meta, new_readings)
    rows = {r.ss_id: r for r in out.collect()}
    assert set(rows) == {1, 2, 99}
    assert rows[99].start_datetime_GMT is None
    assert rows[1].start_datetime_GMT == T("2020-01-01")
    assert dict(out.dtypes)["kWp"] == "float" and dict(out.dtypes)["ss_id"] == "bigint"
    assert "owner_name" not in out.columns


def test_largest_systems_nulls_first(meta):
    got = [r.ss_id for r in largest_systems(meta, 3).collect()]
    assert got == [3, 1, 2]


def test_metadata_csv_roundtrip(spark, meta, new_readings, scratch):
    merged = merge_activity_bounds(meta, new_readings)
    path = f"{scratch}/metadata_csv"
    write_metadata(merged, path)
    text = open([f"{path}/{f}" for f in __import__("os").listdir(path) if f.endswith(".csv")][0]).read()
    assert "2024-03-31T00:00:00Z" in text
    back = read_metadata(spark, path)
    assert sorted(back.collect()) == sorted(merged.collect())


@pytest.mark.parametrize("start", ["2020-01-01 00:00:00", "2020-01-01T00:00:00.000000+0000", "1 Jan 2020"])
def test_other_time_formats_fail_instead_of_reading_as_missing(spark, scratch, start):
    text = spark.createDataFrame([(",".join(METADATA_COLUMNS),), (f"1,{start},2024-01-01T00:00:00Z,51,-1,180,30,4",)], "value string")
    text.coalesce(1).write.text(f"{scratch}/bad")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_metadata(spark, f"{scratch}/bad").collect()


def test_bad_id_fails(spark, scratch):
    text = spark.createDataFrame([(",".join(METADATA_COLUMNS),), ("x1,,,51,-1,180,30,4",)], "value string")
    text.coalesce(1).write.text(f"{scratch}/bad")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_metadata(spark, f"{scratch}/bad").collect()


def test_sinks_stay_parallel_unless_one_file_is_asked_for(spark, scratch, meta):
    import glob

    wide = meta.repartition(4)
    write_metadata(wide, f"{scratch}/many")
    write_metadata(wide, f"{scratch}/one", single_file=True)
    write_csv(wide.drop("start_datetime_GMT", "end_datetime_GMT"), f"{scratch}/plain")
    count = lambda name: len(glob.glob(f"{scratch}/{name}/part-*.csv"))
    assert count("many") > 1 and count("one") == 1 and count("plain") > 1
    assert read_metadata(spark, f"{scratch}/many").count() == read_metadata(spark, f"{scratch}/one").count() == 5
