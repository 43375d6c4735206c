"""A training corpus from ``documents``: five stages, each on all rows the
one before kept. Every stage but the last returns the columns of its input.

1. language ID: texts that no profile claims (no letters, or an order of
   n-grams hardly closer to any language's than that of shuffled letters) go;
2. exact dedup: of equal texts, the row with the largest id stays;
3. MinHash near-dedup: of each near-duplicate class, one document stays;
4. mixing: sources are taken up to their target weights, in whole
   documents, up to twice each;
5. SentencePiece: texts become token ids, each row decoded to check it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.llm import exact_dedup, language_id, minhash_dedup, queries, sentencepiece_codec, source_mixing
from pvtide.llm.common import repeat_rows, shared_folder

# Where there are too few held-out texts to take a cut from: a text's order shares
# almost nothing with any language's below this score.
MIN_LANGUAGE_SCORE = 0.05


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. Profiles are learnt from the
    stage's own input as in query op6, and so are the lowest scores that
    count, from the rows held out of training, by language and size of the
    text (``language_id.score_cuts``). A rejected document is ``und`` or
    scores below (all are, if nothing is labelled)."""
    profiles = language_id.train_profiles(language_id.training_rows(docs))
    cuts = language_id.score_cuts(language_id.held_out_rows(docs), profiles)
    lowest = F.lit(MIN_LANGUAGE_SCORE)
    if cuts:
        table = F.create_map(*[F.lit(x) for (lang, size), cut in cuts.items() for x in (f"{size} {lang}", cut)])
        key = F.concat_ws(" ", language_id.size_class(F.col("n_grams")).cast("string"), "lang_pred")
        lowest = F.greatest(F.coalesce(F.try_element_at(table, key), lowest), lowest)
    judged = language_id.predict_languages(docs, profiles, keep=docs.columns)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN)
                         & (F.col("score") >= lowest)).select("kept.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    plan = source_mixing.plan_mix(docs, queries.SHARDS, queries.SEED)
    return repeat_rows(plan.select("record", "copies"), "copies").select("record.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, ids, n_tokens, round_trip, round_trip_exact`` of every row."""
    model = sentencepiece_codec.load_model()
    return sentencepiece_codec.encode(docs, model, keep=["doc_id", "source"])


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

# Profiles, near-duplicate classes and token ids are not expressible in SQL;
# tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
