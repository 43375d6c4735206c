"""The driver's tables seen as the solar dataset.

The reference ships no data. These views map the given tables onto its
shapes (readings, capacity, metadata, the provider's extract) so that
every job runs on whole tables that grow with the scale factor. Each view
has an SQL twin in ``pvtide.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.schema import END, GEN, SS_ID, START, TS

# Fixed value: the cut between the old metadata and the newly arrived month(s).
METADATA_CUT = dt.date(1999, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine-grained readings: one month of events, ids 0..N."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias(SS_ID), F.col("ts").alias(TS), F.col("value").alias(GEN))


def readings_long(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """Many months of readings, with duplicate keys and values above 100,000."""
    cols = [F.col("l_partkey").alias(SS_ID), F.col("l_shipdate").alias(TS),
            F.col("l_extendedprice").alias(GEN)]
    if extra:
        cols += [F.col("l_orderkey"), F.col("l_linenumber")]
    return table(spark, sf_dir, "lineitem").select(*cols)


def readings_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``readings_long`` with missing values: about one reading in eleven is
    null and one in thirteen NaN."""
    rl = readings_long(spark, sf_dir, extra=True)
    number = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    gen = (F.when(F.pmod(number, F.lit(11)) == 0, F.lit(None))
           .when(F.pmod(number, F.lit(13)) == 0, F.lit(float("nan"))).otherwise(F.col(GEN)))
    return rl.select(SS_ID, TS, gen.alias(GEN))


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kWp per system of ``readings_long``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(SS_ID), F.col("p_size").cast("double").alias("kWp"))


def _site_columns(custkey):
    c = F.col(custkey)
    return {
        "latitude_rounded": F.lit(50.0) + F.pmod(c * F.lit(37), F.lit(1000)) / F.lit(100.0),
        "longitude_rounded": F.lit(-6.0) + F.pmod(c * F.lit(73), F.lit(800)) / F.lit(100.0),
        "orientation": F.pmod(c * F.lit(11), F.lit(360)).cast("double"),
        "tilt": F.pmod(c * F.lit(7), F.lit(91)).cast("double"),
        "kWp": F.pmod(c * F.lit(13), F.lit(2600)) / F.lit(10.0),
    }


def metadata_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's new extract: owner fields plus site fields per customer."""
    site = _site_columns("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(SS_ID),
        F.col("c_nationkey").alias("owner_id"),
        F.col("c_name").alias("owner_name"),
        F.col("c_mktsegment").alias("system_id"),
        *[v.alias(k) for k, v in site.items()])


def metadata_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metadata.csv before the cut: bounds from orders before it, site fields;
    customers without earlier orders have null start and end."""
    orders = (table(spark, sf_dir, "orders")
              .filter(F.col("o_orderdate") < F.lit(METADATA_CUT).cast("timestamp_ntz"))
              .groupBy("o_custkey")
              .agg(F.min("o_orderdate").alias(START), F.max("o_orderdate").alias(END)))
    site = _site_columns("c_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(k) for k, v in site.items()])
    joined = cust.join(orders, cust["c_custkey"] == orders["o_custkey"], "left")
    return joined.select(F.col("c_custkey").alias(SS_ID), START, END,
                         "latitude_rounded", "longitude_rounded", "orientation", "tilt", "kWp")


def readings_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that arrived after the cut (the month P8 merges)."""
    return (table(spark, sf_dir, "orders")
            .filter(F.col("o_orderdate") >= F.lit(METADATA_CUT).cast("timestamp_ntz"))
            .select(F.col("o_custkey").alias(SS_ID), F.col("o_orderdate").alias(TS)))
