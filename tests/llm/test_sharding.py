import zlib

from helpers import AWKWARD, frame, words

from pvtide.llm import queries, sharding


def placed(spark, rows, shards=4, clash=False, **options):
    df = sharding.shuffle_into_shards(frame(spark, rows, clash=clash), shards, seed=3, **options)
    return [(r.record.doc_id, r.record.text, r.shard, r.slot) for r in df.collect()]


def check_law(rows, shards, n):
    sizes = [sorted(s for *_, sh, s in rows if sh == i) for i in range(shards)]
    assert all(own == list(range(len(own))) for own in sizes)
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and sum(map(len, sizes)) == n


def test_every_record_once_and_shards_even(spark):
    got = placed(spark, AWKWARD, 4, clash=True)
    check_law(got, 4, len(AWKWARD))
    assert sorted((r[:2] for r in got), key=str) == sorted((r[:2] for r in AWKWARD), key=str)


def test_reruns_agree_and_order_is_mixed(spark):
    rows = [(i, words(20, i)) for i in range(2000)]
    first, second = placed(spark, rows, 16, block_bytes=2000), placed(spark, rows, 16, block_bytes=2000)
    check_law(first, 16, 2000)
    assert sorted(first) == sorted(second)
    by_shard = [[i for i, _, s, _ in first if s == shard] for shard in range(16)]
    assert all(min(own) < 400 and max(own) > 1600 for own in by_shard)
    slots = {i: (s, slot) for i, _, s, slot in first}
    neighbours = sum(slots[i][0] == slots[i + 1][0] for i in range(1999))
    assert 60 < neighbours < 200  # one in sixteen by chance: 125


def test_hot_text_few_rows_and_empty(spark):
    check_law(placed(spark, [(i, "same") for i in range(500)], 7), 7, 500)
    check_law(placed(spark, [(1, "a"), (2, "b")], 16), 16, 2)
    assert placed(spark, [], 16) == []


def test_repeats_of_one_row_spread_like_other_rows(spark, monkeypatch):
    rows = [(7, words(20, 1))] * 4000 + [(100 + i, words(3, i)) for i in range(16000)]
    first = placed(spark, rows, 16, block_bytes=2000)
    check_law(first, 16, 20_000)
    hot = [[s for i, _, sh, s in first if i == 7 and sh == shard] for shard in range(16)]
    assert sum(map(len, hot)) == 4000 and all(180 < len(own) < 320 for own in hot)  # 250 by chance
    # Equal from another partitioning, and when the repeats are too many to broadcast.
    again = sharding.shuffle_into_shards(frame(spark, rows).repartition(5), 16, seed=3, block_bytes=2000)
    key = lambda r: (r[2], r[3], r[0])
    assert sorted(map(key, first)) == sorted((r.shard, r.slot, r.record.doc_id) for r in again.collect())
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert sorted(map(key, first)) == sorted(map(key, placed(spark, rows, 16, block_bytes=2000)))


def test_repeats_with_columns_that_cannot_be_compared(spark):
    df = frame(spark, [(1, "a")] * 50 + [(2, "b")] * 3, clash=True).selectExpr(
        "*", "map('k', coalesce(doc_id, 0) + cast(rand(1) * 2 as int)) as m")
    got = sharding.shuffle_into_shards(df, 4, seed=1).collect()
    check_law([(r.record.doc_id, r.record.text, r.shard, r.slot) for r in got], 4, 53)
    count = lambda rows: sorted((r.doc_id, r.m["k"]) for r in rows)
    assert count(r.record for r in got) == count(df.collect())


def test_bucket_starts_over_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUP", 3)
    check_law(placed(spark, [(i, words(9, i)) for i in range(900)], 5), 5, 900)


def test_write_and_read_back(spark, scratch):
    rows = [(i, words(5, i)) for i in range(300)]
    sharding.write_shards(frame(spark, rows), f"{scratch}/shards", 4, seed=1)
    back = spark.read.parquet(f"{scratch}/shards")
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {i: 75 for i in range(4)}


def test_query_columns(spark, monkeypatch):
    df = frame(spark, AWKWARD)
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    for r in queries.q_sharding(spark, "").collect():
        text = next(t for i, t, *_ in AWKWARD if i == r.doc_id and zlib.crc32((t or "").encode()) == r.text_crc32)
        assert r["size"] == len((text or "").encode()) + 1 and r.law == "rows" and r.grown_shard is None
