"""Exact deduplication of whole texts.

Method: texts are grouped by a 128-bit content hash (MD5) and, inside a
hash group, by their bytes, so two different texts that share a hash stay
apart. Both keys belong to one grouped aggregation with map-side combining:
the copies of a text collapse before the shuffle, so a text that a third of
all rows carry reaches the reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.llm.common import pick, repeat_rows


def content_hash(text: Column) -> Column:
    """128-bit content hash of a text (hex)."""
    return F.md5(text.cast("binary"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hash_fn=content_hash) -> DataFrame:
    """Every row with the id that stays of its group of equal texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per
    input row. Of equal texts the row with the largest id stays.

    Defined cases: a null text counts as empty; null ids are smaller than
    any other (``keep_id`` is null if all ids of the group are); rows that
    repeat both id and text are all reported, and exactly one of them is
    kept; an empty table gives an empty result; other columns are ignored.

    The first aggregation moves each distinct text once (per map task); the
    report itself joins only ids and digests. The join key is the pair of
    hash and SHA-256, so a hash collision leaves the groups apart; a hot
    text's rows are the streamed side of that join, which AQE splits.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("h", hash_fn(F.col("text")))
    groups = (rows.groupBy("h", "text")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    members = (rows.select("h", F.sha2("text", 256).alias("sha"), "id")
               .groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("n")))
    joined = repeat_rows(members.join(groups, ["h", "sha"]), "n")
    return joined.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    hash_fn=content_hash) -> DataFrame:
    """The whole rows that stay: one per distinct text, columns unchanged.

    One shuffle, with map-side combining. The kept row has the largest id;
    rows that tie on it are ordered by their other columns of orderable
    type, so re-runs keep the same row.
    """
    orderable = [f.name for f in docs.schema.fields if _orderable(f.dataType)]
    order = F.struct(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in orderable if c not in (id_col, text_col)])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    packed = docs.select(text.alias("t"), order.alias("o"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col],
                                  F.col(f"`{text_col}`").isNull().alias("text_is_null__")).alias("r"))
    best = (packed.withColumn("h", hash_fn(F.col("t"))).groupBy("h", "t")
            .agg(F.max_by("r", "o").alias("r")))
    restore = F.when(F.col("r.text_is_null__"), F.lit(None).cast("string")).otherwise(F.col("t"))
    return best.select(*[restore.alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c)
                         for c in docs.columns])


def _orderable(kind) -> bool:
    return not any(word in kind.simpleString() for word in ("map<", "variant", "void"))
