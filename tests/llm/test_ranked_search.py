import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, CLASHES, frame, words

from pvtide.llm import queries, ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, places=50):
    """(item_id, rank, doc_id, score), every document scored."""
    held = [(i, Counter(plain_terms(text))) for i, text in docs]
    lengths = [sum(c.values()) for _, c in held]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        own = []
        for (i, c), n in zip(held, lengths, strict=True):
            score = 0
            for t in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                own.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, e[3], -e[0]) for k, e in enumerate(sorted(own, key=lambda e: e[:3])[:places])]
    return sorted(out, key=str)


def items_frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "item_id long, text string")
    return df.selectExpr("*", *[f"item_id as `{c}`" for c in CLASHES + ["doc_id", "score", "rank", "number", "terms"] if c != "score"]) \
        if clash else df


def test_terms_are_those_of_the_pattern():
    texts = ["One two-THREE_four ÉÀ 12a", None, "", "...", "漢字ABC ×", "a\u0000b", "x"]
    got, bounds = rs.terms_of(pa.array(texts))
    found = [[t.decode() for t in got[a:b].to_pylist()] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert found == [plain_terms(t) for t in texts]


def test_range_maxima():
    rng = np.random.default_rng(1)
    term, doc = np.nonzero(rng.random((7, 90)) < 0.4)
    impact = rng.integers(1, 30, len(term))
    shuffled = rng.permutation(len(term))
    segment = rs.Segment(np.arange(90), term[shuffled], doc[shuffled], impact[shuffled], 7)
    for t in range(7):
        a, b = segment.starts[t], segment.starts[t + 1]
        for _ in range(40):
            low, high = sorted(rng.choice(np.arange(a, b + 1), 2, replace=False))
            place = segment.largest(np.array([low]), np.array([high]))[0]
            assert low <= place < high and segment.impact[place] == segment.impact[low:high].max()


def test_search_equals_brute_force_and_skips_documents(monkeypatch):
    rng = random.Random(8)
    n_docs, n_terms = 3000, 40
    rows = []
    for d in range(n_docs):
        for t in range(n_terms):
            if rng.random() < 1 / (t + 2):
                rows.append((t, d, rng.randint(1, 400) * (50 if rng.random() < 0.01 else 1)))
    term, doc, impact = map(np.array, zip(*rows, strict=True))
    ids = np.arange(n_docs) * 3
    segment = rs.Segment(ids, term, doc, impact, n_terms)
    asked = [rng.sample(range(n_terms), k) for k in (1, 3, 8, 20)]
    padded = np.full((len(asked), 20), -1)
    for r, own in enumerate(asked):
        padded[r, :len(own)] = own
    for leaf in (1, 64):
        monkeypatch.setattr(rs, "LEAF", leaf)
        best = rs.Best(len(asked), 10)
        scored = rs.search(segment, np.arange(len(asked)), padded, best)
        for r, own in enumerate(asked):
            total = np.zeros(n_docs, np.int64)
            for t, d, v in rows:
                total[d] += v * (t in own)
            order = np.lexsort((ids, -total))[:10]
            assert best.id[r].tolist() == ids[order].tolist() and best.score[r].tolist() == total[order].tolist()
        if leaf == 1:
            assert scored < 0.5 * n_docs * len(asked)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_ranked_search"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(items, docs)


def test_awkward_rows(spark, monkeypatch):
    """Nulls, ties, a crowd of equal texts, repeated rows and ids, very long
    texts; several blocks of items and several segments give the same."""
    docs = [(r[0], r[1]) for r in AWKWARD] + [(1000 - i, "the same words in every copy") for i in range(120)]
    docs += [(2000 + i, words(30, i, 60)) for i in range(200)] + [(2000, words(30, 0, 60))] * 3
    items = [(1, "one two THREE"), (2, "the same copy"), (3, None), (4, ""), (5, "!!"), (None, "words every id"),
             (6, words(40, 3, 60)), (6, words(40, 3, 60)), (7, "nowhere-to-be found9"), (8, words(3000, 9, 70))]
    expected = brute(items, docs)
    table, asked = frame(spark, docs, clash=True), items_frame(spark, items, clash=True)
    got = rs.rank_documents(asked, table.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == expected
    monkeypatch.setattr(rs, "BLOCK_TERMS", 40)
    assert sorted(map(tuple, rs.rank_documents(asked, table).collect()), key=str) == expected


def test_segments_are_bounded(monkeypatch):
    monkeypatch.setattr(rs, "SEGMENT_POSTINGS", 10)
    lists = [[0, 1, 2], [1], [], [0, 1, 2, 3], [2, 3], [1, 2, 3]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5, 4, 3, 2, 1, None]), pa.array([9, 9, 0, 9, 9, 9]), pa.array(lists, pa.list_(pa.int32())),
         pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])
    query = rs.Query(np.array([0]), [np.arange(4)], np.array([5, 5, 5, 5]), 6, 45)
    segments = list(rs._segments(batch, query))
    assert [s.ids.tolist() for s in segments] == [[1, 2, 3, 4, 5], [rs.NO_ID]]
    assert [len(s.key) for s in segments] == [10, 3]


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), items_frame(spark, [(1, "a")])
    assert rs.rank_documents(items, frame(spark, [])).count() == 0
    assert rs.rank_documents(items.limit(0), docs).count() == 0
    assert rs.rank_documents(items, docs).count() == 1
