import hashlib

import xxhash
from helpers import AWKWARD, frame, words

from pvtide.llm import winnowing

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def rotate(x, n):
    return ((x << n) | (x >> (64 - n))) & MASK if n else x


def split(text):
    return [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]


def brute_fingerprint(text, k=5, window=8):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in split(text)]
    if not h:
        return []
    h += [0] * (k - len(h))
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for j in range(k):
            g ^= rotate(h[i + j], k - 1 - j)
        grams.append(g)
    chosen = []
    for s in range(max(1, len(grams) - window + 1)):
        own = range(s, min(s + window, len(grams)))
        low = min(grams[i] >> 31 for i in own)
        at = max(i for i in own if grams[i] >> 31 == low)
        if at not in chosen:
            chosen.append(at)
    return [(p, signed(grams[p])) for p in chosen]


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0,
                     signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()))
    order = sorted(rows, key=key, reverse=True)
    out = []
    for i, r in enumerate(order):
        text, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + nxt[:half]
        f, e = brute_fingerprint(text), brute_fingerprint(new)
        out.append((r[0], len(text), new, f, e, jaccard(f, e), jaccard(f, brute_fingerprint(nxt))))
    return sorted(out, key=str)


def found(spark, rows, **options):
    got = winnowing.compare_with_next(frame(spark, rows, **options)).collect()
    pairs = lambda x: [tuple(e) for e in x]
    return sorted(((r[0], r[1], r[2], pairs(r[3]), pairs(r[4]), r[5], r[6]) for r in got), key=str)


def test_matches_brute_force(spark):
    rows = [(7 * i % 401, words(i % 90, i)) for i in range(400)] + [(1000, words(12, 1) + " " + "la la " * 40)]
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    assert found(spark, AWKWARD, clash=True) == brute(AWKWARD)
    assert found(spark, []) == []
    assert found(spark, [(1, "only one text here")]) == brute([(1, "only one text here")])
    nulls = [(None, words(9, i)) for i in range(50)]
    assert found(spark, nulls) == brute(nulls)


def test_match_guarantee(spark):
    """A shared run of k + window - 1 words always gives a shared fingerprint."""
    run = words(winnowing.K + winnowing.WINDOW - 1, 1)
    rows = [(i, f"{words(i, 10 + i)} {run} {words(40 - i, 90 + i)}") for i in range(40)]
    got = winnowing.fingerprint_documents(frame(spark, rows)).collect()
    prints = [{e["hash"] for e in r.fingerprint} for r in got]
    assert all(a & b for a in prints for b in prints)


def test_query_digests(spark, monkeypatch):
    from pvtide.llm import queries

    rows = [(1, words(30, 1)), (2, words(30, 1)), (3, None), (4, "äöü ß 🙂 " * 20)]
    df = frame(spark, rows)
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    got = {r.doc_id: r for r in queries.q_winnowing(spark, "").collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[4].fingerprint
    assert {i: r.edited_sha256 for i, r in got.items()} == {
        r[0]: hashlib.sha256(r[2].encode()).hexdigest() for r in brute(rows)}
    assert got[1].near_edited > got[1].near_next


def unspaced(n, seed, alphabet):
    import random

    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


HAN, THAI = "".join(map(chr, range(0x4E00, 0x4F00))) + "𠀀𠀁", "กขคงจฉชซญฎฐณดตถทธนบปผฝพฟภมยรลวศษสหอฮ"


def test_texts_without_blanks_have_many_grams(spark, monkeypatch):
    """Half-edited texts without blanks keep the half that is the same, and near copies match."""
    from pvtide.llm import queries

    texts = [unspaced(400, 1, HAN), unspaced(400, 2, THAI), unspaced(3000, 3, "abcdef0123(){};=🙂"),
             " ".join(unspaced(9, s, THAI) for s in range(40)), "\n".join(unspaced(7, 50 + s, HAN) for s in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, "漢字 " + texts[0][3:] + " ordinary words")]
    df = frame(spark, rows)
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    got = {r.doc_id: r for r in queries.q_winnowing(spark, "").collect()}
    assert all(r.near_edited > 0.2 and r.n_fingerprints > 40 for r in got.values())
    assert got[10].near_next < 0.1  # after 10 comes 4, another text
    prints = {r.doc_id: {e["hash"] for e in r.fingerprint} for r in winnowing.fingerprint_documents(df).collect()}
    assert len(prints[0] & prints[10]) > 0.8 * len(prints[0])


def test_runs_are_broken_into_code_points(spark):
    """The fingerprint is that of the text with blanks put into its broken runs; prose stays as it is."""
    long, limit = "q" * (winnowing.LONGEST_WORD + 1) + "🙂é", "a" * winnowing.LONGEST_WORD
    cases = [(f"some words {long} and more of them", f"some words {' '.join(long)} and more of them"),
             (f"{limit} two three four five six", f"{limit} two three four five six"),
             ("a 漢字𠀀x b c d", "a 漢 字 𠀀 x b c d"), ("สวัสดี", " ".join("สวัสดี")),
             (words(60, 4), words(60, 4)), ("", ""), (None, "")]
    got = winnowing.fingerprint_documents(frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()
    assert {r.doc_id: [tuple(e) for e in r.fingerprint] for r in got} == {
        i: brute_fingerprint(apart) for i, (_, apart) in enumerate(cases)}
