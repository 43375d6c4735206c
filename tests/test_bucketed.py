from pyspark.sql import functions as F

from conftest import T
from pvtide.operators import bucketed, sampling
from test_snapshots import readings, windows

SPANS = [(3, "2024-02-01 05:00:00", "2024-02-08 05:00:00"), (3, "2024-02-01 05:00:00", "2024-02-08 05:00:00"),
         (7, "2024-01-01 00:00:00", "2024-06-30 00:00:00"), (9, "2024-01-20 09:00:00", "2024-01-20 09:00:00"),
         (100, "2024-02-01 00:00:00", "2024-03-01 00:00:00"), (6, "2024-03-02 00:00:00", "2024-03-01 00:00:00")]


def table(spark, scratch, df, name, **options):
    bucketed.write_bucketed(df, name, f"{scratch}/{name}", 4, **options)
    return name


def test_equals_the_broadcast_fetch(spark, scratch):
    df = readings(spark).union(spark.createDataFrame([(None, T("2024-02-02"), 1.0), (3, None, 2.0)],
                                                     "ss_id int, datetime_GMT timestamp_ntz, generation_Wh float"))
    wanted = windows(spark, SPANS).union(spark.createDataFrame([(None, T("2024-01-01"), T("2024-02-01")), (3, None, None)],
                                                               "ss_id int, window_start timestamp_ntz, window_end timestamp_ntz"))
    expected = sorted(map(tuple, sampling.fetch_windows(df, wanted).collect()))
    assert len(expected) > 100
    for name, days in (("bucketed_month", 28), ("bucketed_day", 1)):
        got = bucketed.fetch_windows(spark, table(spark, scratch, df, name, days=days), wanted)
        assert got.columns == ["ss_id", "datetime_GMT", "generation_Wh", "window_start", "window_end"]
        assert sorted(map(tuple, got.collect())) == expected
        assert spark.table(name).count() == df.count()
    zoned = df.withColumn("datetime_GMT", F.col("datetime_GMT").cast("timestamp"))
    got = bucketed.fetch_windows(spark, table(spark, scratch, zoned, "bucketed_zoned"), wanted)
    assert got.count() == len(expected)


def test_only_windows_are_shuffled(spark, scratch):
    name = table(spark, scratch, readings(spark), "bucketed_plan")
    wanted = windows(spark, SPANS)
    wanted.write.parquet(f"{scratch}/windows")
    wanted = spark.read.parquet(f"{scratch}/windows")
    plan = bucketed.fetch_windows(spark, name, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    side = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange") == 1 and "windows" in side and "generation_Wh" not in side


def test_a_hot_system_is_spread_over_the_buckets(spark, scratch):
    hot = readings(spark, 8000, 40).withColumn("ss_id", F.when(F.rand(1) < 0.4, 1).otherwise(F.col("ss_id")))
    name = table(spark, scratch, hot, "bucketed_hot", days=7)
    sizes = [r["count"] for r in spark.table(name).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * 8000
    of_hot = spark.table(name).filter("ss_id = 1").groupBy(F.input_file_name()).count().count()
    assert of_hot == 4
