"""Registered queries of the training-data operators, and their SQL twins.

Each query runs its operator with production parameters over the whole of
its table. Where SQL can express the result, ``ORACLE_SQL`` has a DuckDB
twin; the others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.llm import (
    embedding_whitening,
    exact_dedup,
    language_id,
    license_scan,
    minhash_dedup,
    quality_model,
    ranked_search,
    sentencepiece_codec,
    sharding,
    source_mixing,
    token_files,
    url_filter,
    winnowing,
)
from pvtide.llm.common import shared_folder

# The tokenizer file of op13 (a path on the driver; its contents travel with the tasks).
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 16
SEED = 20_240_607
# Rules of the URL filter: (action, host and path).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/"))
# Parts of host names that label a URL as unwanted when the URL filter is trained.
SEED_WORDS = ("casino", "bets", "pills", "adult", "spam", "ads", "warez", "porn", "poker", "viagra", "loans")


def documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q_sharding(spark, sf_dir):
    placed = sharding.shuffle_into_shards(documents(spark, sf_dir), SHARDS, SEED)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def q_source_mixing(spark, sf_dir):
    plan = source_mixing.plan_mix(documents(spark, sf_dir), SHARDS, SEED, carry=["doc_id"])
    return plan.select(F.col("record.doc_id").alias("doc_id"), "size", "source_size", "target",
                       F.col("words").alias("taken"), "copies", "shards")


def q_exact_dedup(spark, sf_dir):
    return exact_dedup.duplicate_report(documents(spark, sf_dir))


def q_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(documents(spark, sf_dir)).drop("class_digest")


def q_sentencepiece(spark, sf_dir):
    model = sentencepiece_codec.load_model()
    return sentencepiece_codec.encode(documents(spark, sf_dir), model, keep=["doc_id"])


def q_quality_model(spark, sf_dir):
    return quality_model.score_documents(documents(spark, sf_dir))


def q_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    profiles = language_id.train_profiles(language_id.training_rows(docs))
    judged = language_id.predict_languages(docs, profiles, keep=["doc_id"])
    return judged.select("kept.doc_id", language_id.held_out(F.col("kept.doc_id")).alias("held_out"),
                         "lang_pred", "score")


def q_url_filter(spark, sf_dir):
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, SEED_WORDS)


def q_winnowing(spark, sf_dir):
    found = winnowing.compare_with_next(documents(spark, sf_dir), longest_word=winnowing.LONGEST_WORD)
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                        winnowing.digest(F.col("fingerprint")).alias("fingerprint"),
                        winnowing.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                        "near_edited", "near_next", F.size("fingerprint").alias("n_fingerprints"))


def q_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(documents(spark, sf_dir), license_scan.known_frame(spark),
                                      anchors=license_scan.ANCHORS)


def q_embedding_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = embedding_whitening.fit(table)
    error = 0.0 if model is None else embedding_whitening.identity_error(table, model)
    rows = embedding_whitening.whiten(table, model, keep=["vec_id"])
    # Beyond 64 bits the exact value is in exact_deviation only.
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
                       "explained", F.lit(error).alias("identity_error"), F.col("deviation").alias("exact_deviation"))


def q_ranked_search(spark, sf_dir):
    return ranked_search.rank_documents(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def q_token_files(spark, sf_dir):
    path = shared_folder(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, token_files.load_tokenizer(TOKENIZER), end_id=0)
    return token_files.token_index(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": q_minhash_dedup,
    "op2_sharding": q_sharding,
    "op3_sentencepiece": q_sentencepiece,
    "op4_quality_model": q_quality_model,
    "op5_source_mixing": q_source_mixing,
    "op6_language_id": q_language_id,
    "op7_exact_dedup": q_exact_dedup,
    "op8_url_filter": q_url_filter,
    "op9_winnowing": q_winnowing,
    "op10_license_scan": q_license_scan,
    "op11_embedding_whitening": q_embedding_whitening,
    "op12_ranked_search": q_ranked_search,
    "op13_token_files": q_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op10_license_scan": license_scan.oracle_sql(),
    "op12_ranked_search": ranked_search.oracle_sql(),
}
