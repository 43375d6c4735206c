import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, edited, frame, words

from pvtide.llm import minhash_dedup as near
from pvtide.llm import queries
from pvtide.llm import textkernels as kernels
from pvtide.llm.common import stored as stored_as_is


def shingles(text):
    w = [x for x in "".join(c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if x]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard_p(a, b):
    """Probability Jaccard from its definition, quadratic."""
    x = {k: 1 + math.log(n) for k, n in a.items()}
    y = {k: 1 + math.log(n) for k, n in b.items()}
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys) for d in set(x) & set(y))


def brute_classes(rows):
    """Smallest id of every row's class: components of J_P >= 0.8 over distinct texts."""
    texts = sorted({r[1] or "" for r in rows})
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            posting[k].append(i)
    pairs = {p for own in posting.values() for p in itertools.combinations(own, 2)}
    number_of = {k: n for n, k in enumerate(posting)}
    arrays = []
    for own in sets:
        items = sorted((number_of[k], 1 + math.log(n)) for k, n in own.items())
        arrays.append((np.array([k for k, _ in items], np.uint64), np.array([w for _, w in items])))
    for i, j in pairs:  # the fast form is tested against the definition below
        if find(i) != find(j) and near.probability_jaccard(*arrays[i], *arrays[j]) >= 0.8 - 1e-9:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    number = {t: i for i, t in enumerate(texts)}
    for r in rows:
        ids[find(number[r[1] or ""])].append(r[0])
    small = {c: min((i for i in own if i is not None), default=None) for c, own in ids.items()}
    return sorted(((r[0], small[find(number[r[1] or ""])]) for r in rows), key=str)


def near_rows():
    rows, i = [], 0
    for g in range(40):
        base = words(60 + 11 * g, g)
        for copy in range(1 + g % 5):
            rows.append((i, edited(base, 0.01 * (g % 4), seed=copy) if copy else base))
            i += 3
    rows += [(i + 1 + k, base) for k in range(30)]  # copies of the last text
    shared = words(55, 999)
    rows += [(i + 100 + k, words(200, 5000 + k) + " " + shared) for k in range(60)]  # a common passage, no link
    line = " ".join(["again and again the same line here"] * 30)
    rows += [(i + 200, line + " a"), (i + 201, line + " b"), (i + 202, "short text"), (i + 203, "short  text")]
    return rows


def test_word_and_shingle_hashes_are_those_of_the_words():
    texts = ["a b\tc", "", None, "b", " c  a\n", "a b c d e f", "é a"]
    (first, data, offsets), = kernels.utf8_pieces(pa.array(texts, pa.string()))
    hashes, bounds = kernels.word_hashes(data, offsets)
    found = [hashes[a:b].tolist() for a, b in itertools.pairwise(bounds)]
    name = {}
    for text, own in zip(texts, found, strict=True):
        plain = (text or "").split()
        assert len(own) == len(plain)
        assert all(name.setdefault(w, h) == h for w, h in zip(plain, own, strict=True))
    assert len(set(name.values())) == len(name)
    grams, ends = kernels.shingle_hashes(hashes, bounds, 5)
    assert np.diff(ends).tolist() == [1, 0, 0, 1, 1, 2, 1]


def test_pieces_do_not_change_hashes(monkeypatch):
    texts = pa.array([words(50, i) for i in range(30)])
    whole = [p for p in kernels.utf8_pieces(texts)]
    monkeypatch.setattr(kernels, "PIECE_BYTES", 700)
    parts = [p for p in kernels.utf8_pieces(texts)]
    assert len(whole) == 1 and len(parts) > 10
    assert np.concatenate([kernels.word_hashes(d, o)[0] for _, d, o in parts]).tolist() == \
        kernels.word_hashes(whole[0][1], whole[0][2])[0].tolist()


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = rng.integers(1, 2 ** 63, 300).astype(np.uint64)
        cut = rng.integers(50, 250)
        b = np.concatenate([a[:cut], rng.integers(1, 2 ** 63, 120).astype(np.uint64)])
        wa, wb = rng.integers(1, 6, len(a)).astype(float), rng.integers(1, 6, len(b)).astype(float)
        ia, ib = np.argsort(a), np.argsort(b)
        exact = near.probability_jaccard(a[ia], wa[ia], b[ib], wb[ib])
        agree = np.mean(near.prob_minhash(a[ia], wa[ia]) == near.prob_minhash(b[ib], wb[ib]))
        errors.append(agree - exact)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.16


def test_exact_similarity_follows_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a = {int(k): int(rng.integers(1, 5)) for k in rng.integers(0, 40, 30)}
        b = {int(k): int(rng.integers(1, 5)) for k in rng.integers(0, 40, 30)}
        arrays = [(np.array(sorted(s), np.uint64), 1 + np.log([s[k] for k in sorted(s)])) for s in (a, b)]
        assert abs(near.probability_jaccard(*arrays[0], *arrays[1]) - jaccard_p(a, b)) < 1e-9


def test_bit_planes_count_differing_registers(spark):
    a = np.arange(near.REGISTERS, dtype=np.uint64)
    b = a.copy()
    b[[0, 5, 64, 191]] += np.uint64(3)
    df = spark.createDataFrame([(near.bit_planes(a).tolist(), near.bit_planes(b).tolist())], "a array<long>, b array<long>")
    assert df.select(near._mismatches(df.a, df.b)).first()[0] == 4


def test_classes_match_brute_force(spark):
    """Near copies, copies, a common passage, awkward rows, and a crowd of near
    copies of one text, most of them too far from their bucket's leader."""
    base = words(150, 77)
    crowd = [(200_000 + i, edited(base, 0.002 * (i % 40), seed=i)) for i in range(240)]
    rows = near_rows() + [(r[0] and r[0] + 100_000, *r[1:]) for r in AWKWARD] + crowd
    got = near.near_duplicates(frame(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert all(r.digest == hashlib.md5(text[r.doc_id].encode()).hexdigest() for r in got if r.doc_id is not None)


def test_one_document_of_each_class_stays(spark):
    rows = near_rows() + [(r[0] and r[0] + 100_000, *r[1:]) for r in AWKWARD[:6]] + [(9001, "twice"), (9001, "twice")]
    df = frame(spark, rows, clash=True)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    expected = {c for _, c in brute_classes(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_similar_sets_meet_in_their_prefixes():
    """Any two similar sets share an element of both prefixes, in any order of
    the elements; partners are known by a least size and a largest mass."""
    rng = np.random.default_rng(4)
    similar = 0
    for _ in range(1500):
        n = int(rng.integers(1, 40))
        shared = rng.choice(1000, n, replace=False)
        a, b = ({int(k): 1 + math.log(rng.integers(1, 4)) for k in [*shared, *range(low, low + rng.integers(0, n // 5 + 2))]}
                for low in (2000, 3000))
        for k in shared:
            b[int(k)] = a[int(k)] if rng.random() < 0.9 else b[int(k)]
        arrays = [(np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)])) for s in (a, b)]
        if near.probability_jaccard(*arrays[0], *arrays[1]) < 0.8:
            continue
        similar += 1
        place = {k: rng.random() for k in {**a, **b}}
        prefixes = []
        for own, other in ((a, b), (b, a)):
            order = sorted(own, key=place.get)
            length = near.prefix_lengths(len(own), sum(own.values()), np.array([own[k] for k in order]),
                                         np.array([len(other) - int(rng.integers(0, 2))]),
                                         np.array([sum(other.values()) * (1 + 0.1 * rng.random())]), 0.8)[0]
            prefixes.append(set(order[:length]))
        assert prefixes[0] & prefixes[1]
    assert similar > 200


def crowd(n, seed=0):
    """Edited copies of one text; most pairs of them are not similar, all share buckets."""
    base = words(150, 77)
    return [(i, edited(base, 0.0015 * (i % 25), seed=seed + i)) for i in range(n)]


def test_a_crowd_does_not_make_a_square_of_pairs(spark, monkeypatch):
    counts = []
    for n in (300, 600):
        made = []

        def counted(df, name, made=made):
            out = stored_as_is(df, name)
            if name.endswith("-pairs"):
                made.append(out.count())
            return out

        monkeypatch.setattr(near, "stored", counted)
        rows = crowd(n)
        got = near.near_duplicates(frame(spark, rows)).collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)
        counts.append(sum(made))
    assert counts[1] <= 2.5 * counts[0] and counts[1] < 25 * 600  # of 179,700


def test_clusters_that_share_buckets_need_further_rounds(spark):
    """Two families in the same buckets, one less central than the other, and
    single texts between them."""
    base = words(150, 5)
    other = edited(base, 0.05, seed=3)
    rows = [(i, edited(base, 0.004, seed=i)) for i in range(60)] + [(100 + i, edited(other, 0.004, seed=i)) for i in range(40)]
    rows += [(200 + i, edited(base, 0.03, seed=900 + i)) for i in range(60)]
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)


def test_kept_row_of_repeats_is_defined(spark):
    rows = [(1, "a b c d e f g", "en", s) for s in ("z", "a", None, "m")] + [(2, "a b c d e f g", "en", "a")]
    for parts in (1, 3):
        kept = near.drop_near_duplicates(frame(spark, rows).repartition(parts)).collect()
        assert [(r.doc_id, r.source) for r in kept] == [(1, None)]


def test_classes_of_all_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.QUERIES["op1_minhash_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)


def test_rounds_end_when_a_crowd_is_not_similar_to_its_leaders(spark, monkeypatch):
    """Texts around a common one, similar to it but not enough: a few leaders are not
    compared with all of them, round after round. The exact step still judges them."""
    import random

    from pvtide.llm import minhash_dedup as m

    draw = random.Random(5)
    base = [f"w{i}" for i in range(130)]

    def edited(times):
        words = list(base)
        for at in draw.sample(range(130), times):
            words[at] = f"v{draw.randrange(10 ** 6)}"
        return " ".join(words)

    n = 80
    texts = [" ".join(base)] + [edited(1) for _ in range(9)] + [edited(5) for _ in range(n)]
    compared = {}
    verified = m._verified

    def counted(pairs, sets, threshold, name):
        compared[name] = pairs.count()
        return verified(pairs, sets, threshold, name)

    monkeypatch.setattr(m, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.doc_id: r.class_id for r in m.near_duplicates(docs).collect()}
    assert {classes[i] for i in range(10)} == {0}
    assert sum(classes[i] != i for i in range(10, n + 10)) < n // 4
    assert sum(c for name, c in compared.items() if name.startswith("minhash-round")) <= 3 * n
