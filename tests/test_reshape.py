import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from conftest import T
from pvtide.operators.reshape import dedup, halfhour_slots_to_wide, slot_columns, wide_halfhour_to_tall

WIDE_DDL = "datetime_GMT timestamp, ss_id bigint, " + ", ".join(f"t{k} double" for k in range(1, 49)) + ", tilt double"


def _wide_row(day, ss_id, values):
    slots = [values.get(k) for k in range(1, 49)]
    return (T(day), ss_id, *slots, 30.0)


def test_slot_columns_skip_tilt(spark):
    df = spark.createDataFrame([_wide_row("2024-01-31", 1, {})], WIDE_DDL)
    assert slot_columns(df) == [f"t{k}" for k in range(1, 49)]


def test_t48_lands_next_day_next_month(spark):
    df = spark.createDataFrame([_wide_row("2024-01-31", 7, {1: 1.5, 48: 2.5})], WIDE_DDL)
    tall = wide_halfhour_to_tall(df)
    rows = {r.datetime_GMT: r.generation_Wh for r in tall.collect()}
    assert len(rows) == 48
    assert rows[T("2024-01-31 00:30:00")] == 1.5
    assert rows[T("2024-02-01 00:00:00")] == 2.5
    assert rows[T("2024-01-31 12:00:00")] is None  # empty slots stay as null readings
    assert dict(tall.dtypes) == {"ss_id": "int", "datetime_GMT": "timestamp", "generation_Wh": "float"}


def test_duplicate_wide_rows_removed(spark):
    df = spark.createDataFrame([_wide_row("2024-01-02", 1, {3: 1.0}), _wide_row("2024-01-02", 1, {3: 1.0}),
                                _wide_row("2024-01-03", 1, {3: 2.0})], WIDE_DDL)
    tall = wide_halfhour_to_tall(df)
    assert tall.count() == 96
    assert tall.groupBy("ss_id", "datetime_GMT").count().filter("count > 1").count() == 0


def test_not_midnight_fails_unless_unaligned(spark):
    df = spark.createDataFrame([_wide_row("2024-01-02 12:00:00", 1, {1: 1.0}),
                                _wide_row("2024-01-02 00:00:00", 1, {25: 9.0})], WIDE_DDL)
    with pytest.raises(Exception, match="not a midnight"):
        wide_halfhour_to_tall(df).collect()
    # The noon row's t1 (12:30) and the midnight row's t25 (12:30) collide:
    # tall dedup keeps one of them.
    tall = wide_halfhour_to_tall(df, day_aligned=False)
    assert tall.filter(F.col("datetime_GMT") == T("2024-01-02 12:30:00")).count() == 1
    assert tall.count() == 72  # 96 slots, 24 times overlap
    assert tall.select("datetime_GMT").distinct().count() == tall.count()


def test_dedup_deterministic_keeps_smallest_order(spark):
    df = spark.createDataFrame([(1, T("2024-01-01"), 5.0, 3), (1, T("2024-01-01"), 7.0, 1),
                                (2, T("2024-01-01"), 1.0, 1)],
                               "ss_id int, datetime_GMT timestamp, generation_Wh double, o int")
    out = {r.ss_id: r.generation_Wh for r in dedup(df, ["ss_id", "datetime_GMT"], ["o"]).collect()}
    assert out == {1: 7.0, 2: 1.0}
    assert dedup(df, ["ss_id", "datetime_GMT"]).count() == 2


def test_slots_roundtrip(spark):
    tall = spark.createDataFrame([(1, T("2024-01-05 00:10:00"), 1.0), (1, T("2024-01-05 00:20:00"), 2.0),
                                  (1, T("2024-01-05 23:59:00"), 4.0)],
                                 "ss_id int, datetime_GMT timestamp, generation_Wh double")
    wide = halfhour_slots_to_wide(tall)
    back = wide_halfhour_to_tall(wide).filter("generation_Wh is not null").orderBy("datetime_GMT").collect()
    assert [(r.datetime_GMT, r.generation_Wh) for r in back] == [
        (T("2024-01-05 00:30:00"), 3.0), (T("2024-01-06 00:00:00"), 4.0)]
    assert isinstance(back[0], Row)
