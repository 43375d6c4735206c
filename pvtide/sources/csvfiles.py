"""metadata.csv and the provider's extract: reads (S5-S7) and writes (K5, K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.schema import METADATA, NEW_METADATA

# Fixed value: timestamp format of metadata.csv, e.g. 2025-01-01T03:04:05Z.
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read_metadata(spark: SparkSession, path: str, zone_less: bool = False) -> DataFrame:
    """metadata.csv with parsed timestamps (S5, S6); explicit schema, no
    inference pass over the file. ``...Z`` times are UTC instants
    (``timestamp``); ``zone_less`` reads the same text as ``timestamp_ntz``
    wall-clock times (for data kept zone-less), independent of the session
    time zone. A value that does not parse (another time format, a bad id)
    fails the job: read as null, P8 would take it for missing and fill it."""
    schema = METADATA
    if zone_less:
        schema = T.StructType([T.StructField(f.name, T.TimestampNTZType()) if f.dataType == T.TimestampType()
                               else f for f in METADATA.fields])
    return (spark.read.option("header", True).option("mode", "FAILFAST")
            .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
            .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT)
            .option("timeZone", "UTC").schema(schema).csv(path))


def read_new_metadata(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """The provider's new extract (S7). ``infer=True`` scans the whole file
    for types, as the reference asks; the declared schema avoids that pass."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(NEW_METADATA).csv(path)


def read_with_rejects(spark: SparkSession, path: str, out: str, schema: T.StructType, zone_less: bool = False
                      ) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` lines of CSV files under a declared schema.

    The strict readers above fail on the first bad line; here the rest goes
    on. A line is rejected if a field does not parse or the number of fields
    is wrong; ``rejected`` has ``file``, ``line`` (its text) and ``reason``.
    Good and rejected lines together are all lines but the headers.

    All lines are parsed once, whole, and written to the new folder ``out``;
    both frames read it. (From the CSV scan itself they could not be counted:
    it parses the columns that a query needs, and so sees fewer bad fields.)
    """
    parsed = _parsed(spark, path, schema, zone_less)
    reason = F.when(F.col(_CORRUPT).isNotNull(), _reason(schema))
    (parsed.select(*schema.names, "file", F.col(_CORRUPT).alias("line"), reason.alias("reason"),
                   F.col(_CORRUPT).isNotNull().alias("rejected")).write.partitionBy("rejected").parquet(out))
    kinds = T.StructType([*_times(schema, zone_less).fields, *(T.StructField(c, T.StringType()) for c in ("file", "line", "reason")),
                          T.StructField("rejected", T.BooleanType())])
    back = spark.read.schema(kinds).parquet(out)
    return (back.filter("NOT rejected").select(*schema.names),
            back.filter("rejected").select("file", "line", "reason"))


_CORRUPT = "_corrupt_line"


def _times(schema: T.StructType, zone_less: bool) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.TimestampNTZType()) if zone_less and f.dataType == T.TimestampType() else f
                         for f in schema.fields])


def _parsed(spark: SparkSession, path: str, schema: T.StructType, zone_less: bool) -> DataFrame:
    """Every line, with its text where it did not parse, and its file."""
    lines = T.StructType([*_times(schema, zone_less).fields, T.StructField(_CORRUPT, T.StringType())])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", _CORRUPT).option("timestampFormat", CSV_TIMESTAMP_FORMAT)
            .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT).option("timeZone", "UTC").schema(lines).csv(path)
            .select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")))


def _reason(schema: T.StructType) -> Column:
    """The number of fields if it is wrong, else the columns that are null
    although the line has something there."""
    fields = F.from_csv(F.col(_CORRUPT), F.lit(", ".join(f"c{i} string" for i in range(len(schema) + 1))))
    given = [fields[f"c{i}"].isNotNull() & (fields[f"c{i}"] != "") for i in range(len(schema))]
    bad = F.concat_ws(", ", *[F.when(g & F.col(f"`{n}`").isNull(), F.lit(n)) for g, n in zip(given, schema.names, strict=True)])
    n = F.size(F.split(F.col(_CORRUPT), ","))
    return F.when(bad != "", F.concat(F.lit("does not parse: "), bad)).otherwise(
        F.concat(F.lit("fields: "), n.cast("string"), F.lit(f" of {len(schema)}")))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table as CSV in Spark's default formats, one file per task (K6)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_metadata(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """metadata.csv with ``...T..:..:..Z`` timestamps (K5).

    ``single_file`` gathers the rows (one per system) into one file, behind
    a shuffle, so that the tasks that make them stay parallel. Write to a
    new path, never over the input.
    """
    out = df.repartition(1) if single_file else df
    (out.write.mode(mode).option("header", True).option("timeZone", "UTC")
     .option("timestampFormat", CSV_TIMESTAMP_FORMAT)
     .option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT).csv(path))
