import zlib
from collections import Counter, defaultdict

from helpers import AWKWARD, frame, words

from pvtide.llm import language_id as lid


def brute_grams(text):
    """Counts of 1- to 3-grams of lower-case letters, words padded by a blank."""
    out = Counter()
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    line = " " + " ".join(low.split()) + " " if low.split() else ""
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i:i + n]
            if g != " " and " " not in g[1:-1] and g != "  ":
                out[g] += 1
    return out


def decode(gram):
    chars = []
    while gram:
        code = gram & ((1 << 21) - 1)
        chars.append(" " if code == 1 else chr(code))
        gram >>= 21
    return "".join(reversed(chars))


def test_ngrams_match_brute_force():
    for text in ["", "123 !!", "Ab, a b-É", "  groß STRASSE ", "漢字 kana", words(40, 1)]:
        grams, counts = lid.ngram_counts(text)
        assert {decode(g): n for g, n in zip(grams.tolist(), counts.tolist(), strict=True)} == dict(brute_grams(text))


def brute_profiles(rows, length):
    counts = defaultdict(Counter)
    for i, text, lang, _ in rows:
        if i is not None and lang is not None and text and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(brute_grams(text))
    key = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))[:length]]
    return {lang: rank(c) for lang, c in counts.items() if c}, rank


def brute_predict(text, profiles, rank, length):
    top = rank(brute_grams(text)) if text else []
    if not top or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        d = sum(min(abs(place[g] - i), length) if g in place else length for i, g in enumerate(top))
        if best is None or d < best[0]:
            best = (d, lang)
    return best[1], 1 - best[0] / (length * len(top))


def test_predictions_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()] + [
        (10_000 + i, *r[1:]) for i, r in enumerate(AWKWARD)] + [(None, "null id", "xx", "a")]
    df = frame(spark, rows, clash=True)
    profiles, rank = brute_profiles(rows, lid.PROFILE_LENGTH)
    learnt = lid.train_profiles(lid.training_rows(df))
    assert {k: [decode(g) for g in v.tolist()] for k, v in learnt.items()} == profiles
    got = lid.predict_languages(df, learnt, keep=["doc_id", "text"]).collect()
    for r in got:
        lang, score = brute_predict(r.kept.text, profiles, rank, lid.PROFILE_LENGTH)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12 and 0 <= r.score <= 1


def test_counts_are_the_same_when_flushed(spark, monkeypatch):
    df = frame(spark, [(i, words(30, i), "ab"[i % 2], "s") for i in range(60)])
    whole = lid.train_profiles(df)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([["ab"[i % 2]] * 1 for i in range(60)]).flatten(),
                                        pa.array([words(30, i) for i in range(60)])], names=["lang", "text"])
    monkeypatch.setattr(lid, "FLUSH_GRAMS", 50)
    total = Counter()
    for part in lid._count_partition(iter([batch])):
        for lang, g, n in zip(*[c.to_pylist() for c in part.columns], strict=True):
            total[lang, g] += n
    for lang, profile in whole.items():
        order = sorted(((g, n) for (x, g), n in total.items() if x == lang), key=lambda x: (-x[1], x[0]))
        assert profile.tolist() == [g for g, _ in order[:lid.PROFILE_LENGTH]]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = lid.train_profiles(lid.training_rows(docs))
    got = lid.predict_languages(docs, profiles, keep=["doc_id", "lang"])
    held = got.filter(lid.held_out(got["kept.doc_id"]))
    total, right = held.count(), held.filter("kept.lang = lang_pred").count()
    assert total > 150 and right / total > 0.98


def test_no_labels_and_empty_table(spark):
    unlabelled = frame(spark, [(1, "some text", None, "a"), (2, None, None, "a")])
    assert lid.train_profiles(unlabelled) == {}
    got = lid.predict_languages(unlabelled, {}, keep=["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert lid.predict_languages(frame(spark, []), {}, keep=["doc_id"]).count() == 0
