import pytest
from pyspark.sql import functions as F

from conftest import T
from pvtide.operators import derived, metadata, quality, resample, snapshots
from test_snapshots import month, readings

KINDS = (derived.ID_BITMAPS, derived.ACTIVITY, derived.resample_sums())


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def update_all(table):
    return [derived.update(table, kind) for kind in KINDS]


def with_gaps(df):
    """Null and NaN readings among the others; half hours that hold only null."""
    n = F.dayofyear("datetime_GMT") * 24 + F.hour("datetime_GMT")
    return df.withColumn("generation_Wh", F.when(n % 3 == 0, F.lit(None)).when(n % 7 == 0, F.lit(float("nan")))
                         .otherwise(F.col("generation_Wh")).cast("float"))


def check(table, df):
    """All merged aggregates equal those of a full run over the same readings."""
    expected = df.withColumn("datetime_GMT", F.col("datetime_GMT"))
    assert plain(derived.merged(table, derived.ACTIVITY)) == plain(metadata.activity_bounds(expected))
    full = resample.resample_right_closed(expected, "30 minutes")
    key = lambda rows: sorted(((r[0], r[1], None if r[2] is None else "nan" if r[2] != r[2] else round(r[2], 6))
                               for r in rows), key=str)
    assert key(derived.merged(table, derived.resample_sums()).collect()) == key(full.select("ss_id", "datetime_GMT", "generation_Wh").collect())
    ids = derived.merged(table, derived.ID_BITMAPS)
    assert plain(derived.ids_of(ids)) == plain(quality.distinct_ids(expected.filter("ss_id is not null"))
                                               .select(F.col("ss_id").cast("bigint")))
    by_month = expected.groupBy(F.year("datetime_GMT").cast("smallint"), F.month("datetime_GMT").cast("tinyint")) \
        .agg(F.countDistinct("ss_id"))
    assert plain(derived.id_counts_by_month(table)) == plain(by_month)


def test_only_new_folders_are_scanned_and_late_months_count(spark, scratch):
    """Months that arrive out of order, a rewritten one, and windows that
    two months share (labels of the first midnight)."""
    df, root = with_gaps(readings(spark)), f"{scratch}/table"
    part = lambda *months: df.filter(F.month("datetime_GMT").isin(*months))
    table = snapshots.write_snapshot(part(3, 4), root)
    assert [len(x) for x in update_all(table)] == [2, 2, 2]
    check(table, part(3, 4))
    table = snapshots.write_snapshot(part(1), root)  # an earlier month, later
    with pytest.raises(ValueError, match="update"):
        derived.merged(table, derived.ACTIVITY)
    assert all(len(x) == 1 and "month=01" in x[0] for x in update_all(table))
    check(table, part(1, 3, 4))
    assert update_all(table) == [[], [], []]
    fewer = part(3).filter("ss_id < 9")
    table = snapshots.write_snapshot(fewer, root)  # a month rewritten, with fewer systems
    assert all(len(x) == 1 and "month=03" in x[0] for x in update_all(table))
    check(table, part(1, 4).union(fewer))
    check(snapshots.open_snapshot(spark, root, 1), part(3, 4))  # the states of older versions are still there


def test_ids_of_all_ranges(spark):
    ids = [0, 1, 2, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 10 ** 9, -1, -2, -32_768, -32_769, 2 ** 31 - 1]
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "ss_id long")
    found = derived._merged_bitmaps(derived.id_bitmaps(df))
    assert sorted(r[0] for r in derived.ids_of(found).collect()) == sorted(ids)
    other = spark.createDataFrame([(i,) for i in (1, 9, 10, 65_536, -2, 5_000_000)], "ss_id long")
    both = derived.common_ids(found, derived.id_bitmaps(other))
    assert sorted(r[0] for r in derived.ids_of(both).collect()) == [-2, 1, 9, 65_536]


def test_overlap_and_empty_tables(spark, scratch):
    meta = spark.createDataFrame([(i,) for i in (1, 2, 3, 77)], "ss_id long")
    table = snapshots.write_snapshot(readings(spark), f"{scratch}/table")
    derived.update(table, derived.ID_BITMAPS)
    assert tuple(derived.id_overlap_counts(table, meta).first()) == (40, 3)
    empty = snapshots.write_snapshot(readings(spark).limit(0), f"{scratch}/empty")
    assert update_all(empty) == [[], [], []]
    assert tuple(derived.id_overlap_counts(empty, meta).first()) == (0, 0)
    assert derived.merged(empty, derived.ACTIVITY).count() == 0


def test_failed_update_is_not_read(spark, scratch, monkeypatch):
    table = snapshots.write_snapshot(month(readings(spark), 2), f"{scratch}/table")
    kind = derived.ACTIVITY

    class Stop(Exception):
        pass

    def stopped(*args, **kwargs):
        raise Stop

    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: stopped() if rows else made(rows, *a, **k))
    with pytest.raises(Stop):
        derived.update(table, kind)  # states are written, the folder list is not
    monkeypatch.undo()
    assert len(derived.update(table, kind)) == 1
    assert plain(derived.merged(table, kind)) == plain(metadata.activity_bounds(month(readings(spark), 2)))
    # Two updates that met: one batch counts.
    ledger = spark.read.schema(derived._FOLDERS).json(f"{table.root}/derived/activity/folders/*").first()
    spark.createDataFrame([(ledger.write, ledger.year, ledger.month, "zz")], derived._FOLDERS).coalesce(1).write.json(
        f"{table.root}/derived/activity/folders/zz")
    assert derived.merged(table, kind).count() == 40


def test_times_keep_their_type(spark, scratch):
    zoned = readings(spark).withColumn("datetime_GMT", F.col("datetime_GMT").cast("timestamp"))
    table = snapshots.write_snapshot(zoned, f"{scratch}/zoned")
    derived.update(table, derived.ACTIVITY)
    row = derived.merged(table, derived.ACTIVITY).filter("ss_id = 0").first()
    assert row.start_datetime_GMT == T("2024-01-01")
