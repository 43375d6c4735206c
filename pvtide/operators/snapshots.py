"""A versioned month layout: snapshots, atomic rewrites and a zone map.

Below one root::

    data/write=<id>/year=YYYY/month=MM/part-*.parquet   never changed once written
    manifests/<id>/                                     one row per file of a version
    pointers/<id>/                                      one row per version, written last

A write adds files of its own (copy on write), then a manifest: the files of
the months it brings, and those that the version before had for all other
months. The version exists once its pointer, a single file that Spark's
committer renames into place, is there. So a reader sees the old months or the
new ones, never a mixture, a write that fails leaves the old version, and an
opened snapshot stays readable during later writes. Writers must take turns;
of two that make the same version, one fails.

The manifest is also the zone map: every file's rows, ids and times. It picks
the files of a fetch before anything is listed or planned. Files are sorted by
``(ss_id, datetime_GMT)`` and hold disjoint ranges, so a window needs one file
of a month, or two.

The writer counts what it writes (``observe``, no second evaluation) and the
zone map counts what the files hold; a version whose numbers or checksums
differ is not published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.functions.timecols import first_of_month
from pvtide.operators import layout, sampling
from pvtide.schema import MONTH, SS_ID, TS, YEAR

WRITE = "write"
# Zone rows that a reader keeps at hand to pick files without a job (some 200 bytes each).
MAX_ZONE_ROWS = 100_000
POINTER = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("files", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("columns", T.StringType()),
    T.StructField("beside", T.ArrayType(T.StringType()))])


def _zone_schema(columns: T.StructType) -> T.StructType:
    kinds = {f.name: f.dataType for f in columns.fields}
    return T.StructType([
        T.StructField("file", T.StringType()), T.StructField(WRITE, T.StringType()),
        T.StructField(YEAR, T.ShortType()), T.StructField(MONTH, T.ByteType()), T.StructField("rows", T.LongType()),
        T.StructField("id_min", kinds[SS_ID]), T.StructField("id_max", kinds[SS_ID]),
        T.StructField("ts_min", kinds[TS]), T.StructField("ts_max", kinds[TS])])


def _scan_schema(columns: T.StructType) -> T.StructType:
    return T.StructType([*columns.fields, T.StructField(WRITE, T.StringType()),
                         T.StructField(YEAR, T.ShortType()), T.StructField(MONTH, T.ByteType())])


@dataclass(frozen=True)
class Snapshot:
    """One version of the table, as it was when it was opened."""

    spark: SparkSession
    root: str
    version: int
    name: str
    n_files: int
    n_rows: int
    columns: T.StructType
    tables: tuple[str, ...] = ()

    def has_beside(self, kind: str) -> bool:
        """Whether the version was published with such a table beside it."""
        return kind in self.tables

    def beside(self, kind: str) -> str:
        return f"{self.root}/beside/{kind}/{self.name}"

    def zones(self) -> DataFrame:
        """The zone map: ``file, write, year, month, rows, id_min, id_max,
        ts_min, ts_max`` of every file."""
        return self.spark.read.schema(_zone_schema(self.columns)).parquet(f"{self.root}/manifests/{self.name}")

    @cached_property
    def _zone_rows(self) -> list[tuple] | None:
        """(file, least id, largest id, first time, last time) of every file,
        times in the exact form of ``sampling.few_windows``."""
        if self.n_files > MAX_ZONE_ROWS:
            return None
        times = [sampling.exact_time(c, self._ts_type) for c in ("ts_min", "ts_max")]
        known = self.zones().filter("id_min IS NOT NULL AND ts_min IS NOT NULL")
        return [tuple(r) for r in known.select("file", "id_min", "id_max", *times).collect()]

    def scan(self, paths: list[str], keep_write: bool = False) -> DataFrame:
        """Readings with their keys of some files or folders (relative to the
        root); ``keep_write`` adds the write that each reading's folder is of."""
        if paths:
            found = (self.spark.read.schema(_scan_schema(self.columns)).option("basePath", f"{self.root}/data")
                     .parquet(*[f"{self.root}/{p}" for p in paths]))
        else:
            found = self.spark.createDataFrame([], _scan_schema(self.columns))
        return found if keep_write else found.drop(WRITE)

    def readings(self) -> DataFrame:
        """All readings, with ``year`` and ``month``: a scan of the version's
        month folders (one per month, whatever the number of files)."""
        months = self.zones().select(WRITE, YEAR, MONTH).distinct().orderBy(YEAR, MONTH).collect()
        return self.scan([f"data/{WRITE}={r[0]}/{YEAR}={r[1]}/{MONTH}={r[2]:02d}" for r in months])

    def files_for(self, windows: DataFrame) -> list[str]:
        """The files that can hold readings of the windows: an equi-join of
        the windows' months with the zone map, then the ranges."""
        kind = dict(self.zones().dtypes)["ts_min"]
        start, end = (F.col(c).cast(kind) for c in (sampling.W_START, sampling.W_END))
        month = F.explode(F.sequence(first_of_month(start), first_of_month(end), F.expr("INTERVAL 1 MONTH")))
        wanted = (windows.filter(F.col(SS_ID).isNotNull() & (start <= end))
                  .select(F.col(SS_ID).alias("id"), start.alias("w_start"), end.alias("w_end"), month.alias("m"))
                  .select("id", "w_start", "w_end", F.year("m").cast("smallint").alias(YEAR),
                          F.month("m").cast("tinyint").alias(MONTH)))
        met = self.zones().join(wanted, [YEAR, MONTH]).filter(
            F.col("id").between(F.col("id_min"), F.col("id_max"))
            & (F.col("w_start") <= F.col("ts_max")) & (F.col("w_end") >= F.col("ts_min")))
        # No more rows than the version has files, which a scan of it would list here too.
        return sorted(r[0] for r in met.select("file").distinct().collect())

    def fetch_windows(self, windows: DataFrame, literal_windows: bool = False, **options) -> DataFrame:
        """All readings of each ``(ss_id, window_start, window_end)``, as
        ``sampling.fetch_windows`` gives them, from the files that the zone
        map picks. ``literal_windows`` (a handful of windows, as there) picks them
        without a further job once the zone map is at hand."""
        if not literal_windows or self._zone_rows is None:
            return sampling.fetch_windows(self.scan(self.files_for(windows)), windows, literal_windows=literal_windows, **options)
        rows = sampling.few_windows(windows, self.columns)
        files = sorted({name for name, low, high, first, last in self._zone_rows for i, start, end in rows
                        if low <= i <= high and first <= end and last >= start})
        return sampling.fetch_few(self.scan(files).drop(YEAR, MONTH), rows)

    @property
    def _ts_type(self) -> str:
        return self.columns[TS].dataType.simpleString()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """One row per version: ``version, name, files, rows, columns, beside``."""
    return spark.read.schema(POINTER).json(f"{root.rstrip('/')}/pointers/*")


def open_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The latest version, or the given one; None if there is none yet."""
    try:
        found = versions(spark, root)
        found = found if version is None else found.filter(F.col("version") == version)
        # Of one version's pointers the first by name counts (see ``_publish``).
        row = found.orderBy(F.desc("version"), "name").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        if version is not None:
            raise ValueError(f"{root} has no version {version}")
        return None
    return Snapshot(spark, root.rstrip("/"), row.version, row.name, row.files, row.rows,
                    T.StructType.fromJson(json.loads(row.columns)), tuple(row.beside or ()))


def write_snapshot(readings: DataFrame, root: str, months=None, replace_all: bool = False,
                   num_partitions: int | None = None, one_file: bool = False,
                   row_group_bytes: int | None = None, keep_keys: bool = False,
                   beside: dict[str, Callable[[str], None]] | None = None) -> Snapshot:
    """Publish a new version (K2): ``readings`` replace the months they fall
    in, and the ``(year, month)`` pairs of ``months``, which may so become
    empty; all other months stay (``replace_all``: none does). Returns the
    new version. Columns must be those of the versions before. ``keep_keys``
    files rows under the keys they carry. ``beside``: writers of further
    tables of the version, each called with the path to write to; they are
    done before the version is published.

    The cost is one sorted write of the readings and one pass over ids and
    times of the files just written; months that stay are not touched.
    """
    spark, root = readings.sparkSession, root.rstrip("/")
    before = open_snapshot(spark, root)
    columns = T.StructType([f for f in readings.schema.fields if f.name not in (YEAR, MONTH)])
    if before is not None and not replace_all and [(f.name, f.dataType) for f in columns] != \
            [(f.name, f.dataType) for f in before.columns]:
        raise ValueError("the readings' columns differ from the table's")
    version = 1 if before is None else before.version + 1
    name = f"{version:08d}-{uuid.uuid4().hex}"
    path, written = f"{root}/data/{WRITE}={name}", Observation()
    layout.write_sorted_months(readings, path, num_partitions=num_partitions, one_file=one_file,
                               row_group_bytes=row_group_bytes, keep_keys=keep_keys, observation=written)

    found = spark.read.schema(_scan_schema(columns)).option("basePath", f"{root}/data").parquet(path)
    relative = F.concat(F.lit(f"data/{WRITE}="), F.substring_index("_metadata.file_path", f"/data/{WRITE}=", -1))
    zones = (found.groupBy(relative.alias("file"), WRITE, YEAR, MONTH)
             .agg(F.count(F.lit(1)).alias("rows"), F.min(SS_ID).alias("id_min"), F.max(SS_ID).alias("id_max"),
                  F.min(TS).alias("ts_min"), F.max(TS).alias("ts_max"), layout.key_checksum().alias("checksum")))
    fresh = f"{root}/manifests/{name}-new"  # the new files only, with their checksums
    zones.write.parquet(fresh)
    schema = _zone_schema(columns)
    zones = spark.read.schema(schema.add("checksum", "string")).parquet(fresh)
    _require_same(written.get, zones.agg(F.coalesce(F.sum("rows"), F.lit(0)),
                                         F.coalesce(F.sum(F.col("checksum").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
                                         .cast("string")).first())
    zones = zones.drop("checksum")
    if before is not None and not replace_all:
        gone = zones.select(YEAR, MONTH).distinct()
        if months:
            gone = gone.union(spark.createDataFrame([(int(y), int(m)) for y, m in months], f"{YEAR} smallint, {MONTH} tinyint"))
        zones = zones.unionByName(before.zones().join(gone, [YEAR, MONTH], "left_anti"))
    zones.orderBy(YEAR, MONTH, "id_min", "ts_min").write.parquet(f"{root}/manifests/{name}")
    for kind, write in (beside or {}).items():
        write(f"{root}/beside/{kind}/{name}")
    return _publish(spark, root, version, name, columns, sorted(beside or {}))


def _require_same(written: dict, held) -> None:
    """The rows that went into the writer are those that its files hold."""
    if (written["rows"], written["checksum"]) != (held[0], held[1]):
        raise RuntimeError(f"the files hold {held[0]} rows (checksum {held[1]}), "
                           f"the writer got {written['rows']} ({written['checksum']}); not published")


def _publish(spark: SparkSession, root: str, version: int, name: str, columns: T.StructType,
             beside: list[str] | None = None) -> Snapshot:
    """Write the version's pointer. If another writer made the same version
    meanwhile, the first by name is the version; the other fails."""
    files, rows = spark.read.parquet(f"{root}/manifests/{name}").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    pointer = spark.createDataFrame([(version, name, files, rows, columns.json(), beside or [])], POINTER)
    pointer.coalesce(1).write.json(f"{root}/pointers/{name}")
    published = open_snapshot(spark, root, version)
    if published.name != name:
        raise RuntimeError(f"another writer has made version {version}")
    return published
