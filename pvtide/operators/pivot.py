"""Tall readings to the system-wide matrix (P6, A10) and back.

Three forms:

* ``pivot_blocks``: the matrix cut into blocks of a fixed number of ids. A
  row is one time and one block; its columns are the ids' places inside the
  block, so the schema is constant whatever the number of systems, no id
  list is needed, and a busy timestamp is spread over its blocks.
* ``pivot_systems_map``: one ``map<id, value>`` per timestamp.
* ``pivot_systems``: one float column per id of an explicit list.

All raise on a duplicate ``(datetime_GMT, ss_id)``, as a pivot without an
aggregate does in the reference. Duplicates are counted with map-side
combining, in the block form where a block's readings meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.operators.layout import estimated_partitions, require_time_statistics
from pvtide.operators.reshape import quote
from pvtide.schema import BLOCK, BLOCK_WIDTH, GEN, SS_ID, TS, block_column


DUPLICATE = "duplicate (datetime_GMT, ss_id) in pivot input"
# Columns that share one presence mask (a bigint) when a wide row is packed.
PACK_WIDTH = 62


def _checked_values(df: DataFrame, value: str) -> DataFrame:
    """One value per (time, id); a duplicate key fails the job."""
    return (df.groupBy(TS, SS_ID)
            .agg(F.when(F.count(F.lit(1)) > 1,
                        F.raise_error(F.lit(DUPLICATE)))
                 .otherwise(F.first(F.col(value))).cast("float").alias(value)))


def id_block(ss_id: Column, width: int = BLOCK_WIDTH) -> Column:
    """Block of an id: ids ``block * width`` to ``block * width + width - 1``."""
    return F.floor(ss_id / F.lit(width)).cast("bigint")


def pivot_blocks(df: DataFrame, value: str = GEN, width: int = BLOCK_WIDTH) -> DataFrame:
    """``datetime_GMT, id_block`` + one float column per place in the block.

    Column ``c007`` of block 3 holds id ``3 * width + 7``. One constant
    schema for any number of systems; a group holds at most ``width`` values.

    One shuffle, of the narrow readings on time and block. A task then sorts
    them and fills one wide row at a time, so its memory goes with its
    readings and not with ``width`` times its groups. Duplicates are seen
    there too: a group has more rows than places that occur, counted as the
    bits of masks of 62 places each.
    """
    ids = F.col(SS_ID)
    place = F.pmod(ids, F.lit(width)).cast("int")
    placed = df.select(TS, id_block(ids, width).alias(BLOCK), place.alias("_place"), F.col(value).cast("float").alias(value))
    # One value at most in a cell, so its maximum is that value.
    places = [F.max(F.when(F.col("_place") == i, F.col(value))).alias(block_column(i, width)) for i in range(width)]
    masks = [F.bit_or(F.when(F.col("_place").between(low, low + 61), F.expr(f"shiftleft(1L, _place - {low})")))
             for low in range(0, width, 62)]
    named = [mask.alias(f"_mask{i}") for i, mask in enumerate(masks)]
    # A struct among the aggregates lets Spark aggregate by sorting: a hash
    # aggregate would hold the wide row of every group of a task at once.
    grouped = (placed.repartition(TS, BLOCK).groupBy(TS, BLOCK)
               .agg(*places, F.count(F.lit(1)).alias("_rows"), F.first(F.struct(BLOCK)).alias("_group"), *named))
    seen = sum((F.bit_count(F.coalesce(F.col(f"_mask{i}"), F.lit(0).cast("bigint"))) for i in range(len(masks))), F.lit(0))
    # The check stands in a column of the result, so no plan drops it.
    block = F.when((F.col(BLOCK).isNotNull()) & (F.col("_rows") != seen), F.raise_error(F.lit(DUPLICATE)).cast("bigint")) \
        .otherwise(F.col("_group")[BLOCK])
    return grouped.select(TS, block.alias(BLOCK), *[block_column(i, width) for i in range(width)])


def blocks_to_tall(wide: DataFrame, value: str = GEN, width: int = BLOCK_WIDTH) -> DataFrame:
    """Block form back to ``(datetime_GMT, ss_id, value)``; empty cells dropped."""
    cells = F.inline(F.array(*[F.struct((F.col(BLOCK) * width + i).cast("int").alias(SS_ID),
                                        F.col(block_column(i, width)).alias(value)) for i in range(width)]))
    return wide.select(TS, cells).filter(F.col(value).isNotNull())


def pivot_systems(df: DataFrame, ids, value: str = GEN) -> DataFrame:
    """``datetime_GMT`` + one float column per id of the caller's list, ids in
    numeric order. Planning and code generation cost grow with the list
    (about 3 ms an id); for all systems use ``pivot_blocks``."""
    ids = sorted({int(i) for i in ids})
    checked = _checked_values(df.select(TS, SS_ID, value).filter(F.col(SS_ID).isin(ids)), value)
    # Columns come out in the order of ``ids``; no reordering projection
    # (building one Column per id costs more than the pivot at 30k ids).
    return checked.groupBy(TS).pivot(SS_ID, ids).agg(F.first(value))


def pivot_systems_map(df: DataFrame, value: str = GEN, out: str = "values") -> DataFrame:
    """``datetime_GMT`` + ``map<ss_id, float>`` of every system reporting then.

    Duplicates fail before the maps are gathered, so a map holds one entry
    per system and its size is bounded by the number of systems.
    """
    checked = _checked_values(df.select(TS, SS_ID, value), value)
    entries = F.array_sort(F.collect_list(F.struct(F.col(SS_ID), F.col(value))))
    return checked.groupBy(TS).agg(F.map_from_entries(entries).alias(out))


def map_to_tall(df: DataFrame, column: str = "values", value: str = GEN) -> DataFrame:
    """Explode the map form back to ``(datetime_GMT, ss_id, value)``."""
    return df.select(TS, F.explode(F.col(column)).alias(SS_ID, value))


def wide_to_tall(df: DataFrame, value: str = GEN) -> DataFrame:
    """Unpivot the wide form back to tall rows; empty cells dropped."""
    id_cols = [c for c in df.columns if c != TS]
    tall = df.unpivot([TS], id_cols, SS_ID, value)
    return (tall.filter(F.col(value).isNotNull())
            .select(TS, F.col(SS_ID).cast("int").alias(SS_ID), value))


def _packs(df: DataFrame, keep: list[str]) -> list[list[str]]:
    """The columns outside ``keep``, those of one type together, in runs of
    ``PACK_WIDTH``."""
    by_type: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        if name not in keep:
            by_type.setdefault(kind, []).append(name)
    return [names[i:i + PACK_WIDTH] for names in by_type.values() for i in range(0, len(names), PACK_WIDTH)]


def _packed(df: DataFrame, keep: list[str], packs: list[list[str]]) -> DataFrame:
    """``keep``, and per pack a mask of the columns that are not null and the
    array of their values: a row's size goes with its filled cells."""
    cells = []
    for n, names in enumerate(packs):
        bits = " | ".join(f"CASE WHEN {quote(c)} IS NULL THEN 0L ELSE {1 << i}L END" for i, c in enumerate(names))
        values = ", ".join(quote(c) for c in names)
        cells += [f"{bits} AS _mask{n}", f"array_compact(array({values})) AS _cells{n}"]
    return df.selectExpr(*[quote(c) for c in keep], *cells)


def _unpacked(df: DataFrame, columns: list[str], packs: list[list[str]]) -> DataFrame:
    """The ``columns`` of the frame that was packed; a value's place in its
    array is the number of filled columns before it."""
    cells = {c: f"CASE WHEN (_mask{n} & {1 << i}L) != 0 THEN get(_cells{n}, bit_count(_mask{n} & {(1 << i) - 1}L)) END AS {quote(c)}"
             for n, names in enumerate(packs) for i, c in enumerate(names)}
    return df.selectExpr(*[cells.get(c, quote(c)) for c in columns])


def write_wide_months(wide: DataFrame, path: str, mode: str = "errorifexists",
                      one_file: bool = False, num_partitions: int | None = None) -> None:
    """Write a wide matrix (id columns or blocks) as time-sorted month files
    (K4): ``path/year=YYYY/month=MM``.

    Default: range-partitioned on ``(year, month, datetime_GMT)`` and the
    block, so a month is split into several files with disjoint, ordered
    ranges. ``one_file=True`` is the reference's layout: one file, and so
    one task, per month.

    Rows are shuffled and sorted packed, and widened one at a time as they
    are written, so a task's memory goes with its filled cells and not with
    rows times columns.
    """
    require_time_statistics(wide)
    keyed = wide.withColumns({"year": F.year(TS).cast("smallint"), "month": F.date_format(TS, "MM")})
    order = ["year", "month", TS] + ([BLOCK] if BLOCK in wide.columns else [])
    num_partitions = num_partitions or estimated_partitions(wide)
    packs = _packs(keyed, order)
    packed = _packed(keyed, order, packs)
    if one_file:
        arranged = packed.repartition("year", "month")
    elif num_partitions:
        arranged = packed.repartitionByRange(num_partitions, *order)
    else:
        arranged = packed.repartitionByRange(*order)
    (_unpacked(arranged.sortWithinPartitions(*order), keyed.columns, packs)
     .write.mode(mode).partitionBy("year", "month").parquet(path))
