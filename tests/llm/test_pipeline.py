"""The corpus pipeline, stage by stage, against brute-force versions."""

from collections import Counter

import pytest
import test_language_id as language
import test_minhash_dedup as near
import test_source_mixing as mixing
from helpers import AWKWARD, edited, frame, words

import corpus_pipeline
from pvtide.llm import language_id, sentencepiece_codec

sentencepiece = pytest.importorskip("sentencepiece")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rows = [(i, words(40 + i % 50, i), ("en", "fr")[i % 2], f"src{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "src1") for i in range(20)]  # exact copies
    rows += [(300 + i, edited(rows[i][1], 0.01, i), "en", None) for i in range(30)]  # near copies
    return rows + [(1000 + k, *r[1:]) for k, r in enumerate(AWKWARD)] + [(None, words(30, 7777), None, "src2")]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, as (doc_id, text, lang, source) tuples; the last as Rows."""
    df, out = frame(spark, corpus()), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, df, "").collect()
        out.append(rows)
        if rows and list(rows[0].__fields__) == COLUMNS:
            df = spark.createDataFrame(rows, df.schema)
    return out


def plain(rows):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in rows), key=str)


def test_language_stage_rejects_what_has_no_language(stages):
    rows = corpus()
    profiles, rank = language.brute_profiles(rows, language_id.PROFILE_LENGTH)
    keep = []
    for r in rows:
        lang, score = language.brute_predict(r[1], profiles, rank, language_id.PROFILE_LENGTH)
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            keep.append(r)
    assert plain(stages[0]) == sorted(keep, key=str)
    assert {r.doc_id for r in stages[0]} >= set(range(120))


def test_exact_stage_keeps_the_largest_id(stages):
    best = {}
    for r in stages[0]:
        old = best.get(r.text)
        if old is None or (r.doc_id is not None and (old.doc_id is None or r.doc_id > old.doc_id)):
            best[r.text] = r
    assert plain(stages[1]) == plain(best.values())


def test_near_stage_keeps_one_of_each_class(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    keep = {c for _, c in near.brute_classes(rows)}
    got = plain(stages[2])
    assert {r[0] for r in got} == keep and len(got) == len(keep)
    assert set(got) <= set(plain(stages[1]))


def test_mixing_stage_meets_the_targets(stages):
    rows = plain(stages[2])
    targets = mixing.targets_by_hand(mixing.sizes_of(rows))
    taken, times = Counter(), Counter(plain(stages[3]))
    assert set(times) <= set(rows) and max(times.values()) <= 2
    longest = Counter()
    for r, n in times.items():
        taken[r[3]] += n * len(mixing.WORD.findall(r[1]))
    for r in rows:
        longest[r[3]] = max(longest[r[3]], len(mixing.WORD.findall(r[1])))
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in targets.items())


def test_token_stage_encodes_every_row(stages):
    processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.load_model())
    texts = {r.doc_id: r.text for r in stages[3]}
    assert Counter(r.doc_id for r in stages[4]) == Counter(r.doc_id for r in stages[3])
    for r in stages[4]:
        assert r.ids == processor.encode(texts[r.doc_id]) and r.round_trip


def test_run_composes_the_stages(spark, stages, scratch):
    frame(spark, corpus()).write.parquet(f"{scratch}/documents.parquet")
    got = corpus_pipeline.run(spark, scratch)
    key = lambda r: (str(r.doc_id), tuple(r.ids))
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[-1]))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "minhash_dedup", "source_mixing", "sentencepiece"]


def test_stages_take_clashing_columns_and_empty_tables(spark):
    clash, empty = frame(spark, AWKWARD + corpus()[:20], clash=True), frame(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0, name
        if name != "minhash_dedup":  # its clashes: test_one_document_of_each_class_stays
            out = stage(spark, clash, "")
            assert out.columns == clash.columns, name
            out.count()
    assert corpus_pipeline.encode_texts(spark, clash, "").count() == clash.count()
    assert corpus_pipeline.encode_texts(spark, empty, "").count() == 0


POLISH = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
          "sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i "
          "wolności zawarte w niniejszej Deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka")


def test_language_stage_rejects_noise_and_unlearnt_languages(spark):
    """All documents of sf0.1 stay; letter noise, base64 and unlearnt languages go."""
    import base64
    import random

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(*COLUMNS)
    clean = docs.filter(F.regexp_count("text", F.lit(r"\p{L}")) > 0)
    rng = random.Random(3)
    bad = [POLISH, POLISH * 3, POLISH[:120]]
    for n in (30, 120, 700):
        bad.append(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
                            for _ in range(n)))
        bad.append(base64.b64encode(rng.randbytes(6 * n)).decode())
    extra = frame(spark, [(-1 - i, t, None) for i, t in enumerate(bad)]).select(*COLUMNS)
    got = corpus_pipeline.identify_languages(spark, docs.unionByName(extra), "")
    assert got.filter("doc_id < 0").count() == 0
    assert clean.select("doc_id").subtract(got.select("doc_id")).count() == 0
    assert got.filter("doc_id >= 0").count() == clean.count()
    # Learnt without German, most German documents go.
    unlearnt = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    kept = corpus_pipeline.identify_languages(spark, unlearnt, "").select("doc_id").join(docs, "doc_id")
    by_lang = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    all_by = {r.lang: r["count"] for r in clean.groupBy("lang").count().collect()}
    assert by_lang.get("de", 0) < 0.1 * all_by["de"]
    assert all(by_lang[x] == n for x, n in all_by.items() if x != "de")
