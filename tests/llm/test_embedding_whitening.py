import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pvtide.llm import embedding_whitening as ew
from pvtide.llm import queries


def plain_x(vectors):
    """x of the usable vectors, entry by entry."""
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors
            if v and all(c is not None and math.isfinite(c) for c in v)]


def plain_moments(rows):
    width = range(len(rows[0]))
    return (len(rows), [sum(r[i] for r in rows) for i in width],
            {(i, j): sum(r[i] * r[j] for r in rows) for i in width for j in width if i <= j})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 150), st.sampled_from([0, 1, 700, 2 ** 31, 2 ** 45, 2 ** 62]), st.randoms())
def test_planes_give_exact_products(width, rows, spread, rng):
    x = [[rng.randint(-spread, spread) for _ in range(width)] for _ in range(rows)]
    found = ew.Scatter()
    cut = rng.randint(0, rows)
    for part in (x[:cut], x[cut:]):
        found.add(np.array(part, np.int64).reshape(len(part), width))
    n, sums, products = plain_moments(x)
    assert found.n == n and list(found.sums) == sums
    assert all(found.products[i, j] == v for (i, j), v in products.items())
    for value in [*sums, *products.values()]:
        assert ew._whole(ew._limbs(int(value))) == value


def test_plane_layout():
    y = np.array([[5, 0], [1, 3], [4, 2]], np.uint64)
    planes, dimension, bit = ew.bit_planes(y)
    assert list(zip(dimension, bit, strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert np.bitwise_count(planes).sum(axis=1).tolist() == [2, 0, 2, 1, 2]


def test_blocks_and_unusable_rows(monkeypatch):
    monkeypatch.setattr(ew, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    vectors = [list(map(float, v)) for v in rng.normal(0, 3, (40, 4))]
    vectors[3], vectors[9][2], vectors[11][0], vectors[12][1], vectors[20] = None, None, math.nan, -math.inf, []
    used, x = ew.quantised(pa.array(vectors, pa.list_(pa.float64())).slice(1))
    assert (used + 1).tolist() == [i for i in range(1, 40) if i not in (3, 9, 11, 12, 20)]
    assert x.tolist() == plain_x(vectors[1:])
    found = ew.Scatter()
    found.add(x)
    assert (found.n, list(found.sums)) == plain_moments(x.tolist())[:2]
    with pytest.raises(ValueError, match="different numbers"):
        ew.quantised(pa.array([[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError, match="too large"):
        ew.quantised(pa.array([[1e300]]))


def check(got, vectors_by_id, components=8):
    """The rows against exact moments and numpy's eigh of them."""
    usable = [(i, r) for i, v in vectors_by_id for r in plain_x([v])]
    n, sums, products = plain_moments([r for _, r in usable])
    width = len(sums)
    centred = [[Fraction(n * products[min(i, j), max(i, j)] - sums[i] * sums[j], n * n) for j in range(width)]
               for i in range(width)]
    covariance = np.array([[float(v) for v in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(components, width)
    assert len(got) == len(usable) * size
    exact = {}
    for i, r in usable:
        exact.setdefault(i, []).append((sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True)),
                                        [float(Fraction(a) - Fraction(b, n)) for a, b in zip(r, sums, strict=True)]))
    signs = {}
    for row in got:
        assert row.n == n and (row.deviation, row.component) in {(d, row.component) for d, _ in exact[row.vec_id]}
        _, centred_row = next(e for e in exact[row.vec_id] if e[0] == row.deviation)
        k = row.component - 1
        expected = float(np.dot(centred_row, vectors[:, k])) / math.sqrt(values[k])
        if k not in signs and abs(expected) > 1e-3:
            signs[k] = math.copysign(1, expected * row.whitened)
        assert abs(row.whitened - signs.get(k, 1) * expected) < 1e-6
        assert abs(row.explained - values[k] / np.trace(covariance)) < 1e-10
    return got


def test_query_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = queries.QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.01")
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes[:7]] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = check(got.collect(), [(r.vec_id, r.embedding) for r in table.collect()])
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    whitened = {}
    for r in rows:
        whitened.setdefault(r.vec_id, {})[r.component] = r.whitened
    w = np.array([[v[k] for k in range(1, 9)] for v in whitened.values()])
    assert abs(np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() - rows[0].identity_error) < 1e-12


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows],
                                 "vec_id long, embedding array<float>, component int, n double")


def run(spark, rows, parts=3):
    table = frame(spark, rows).repartition(parts)
    model = ew.fit(table)
    return model, ew.whiten(table, model).collect()


def test_awkward_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(0, 200, 5).astype(np.float32)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    rows += [rows[4]] * 25 + [(None, rows[5][1])]
    _, got = run(spark, rows)
    check(got, rows)


def test_without_variance(spark):
    model, got = run(spark, [(i, [0.5, -0.25, 1.0]) for i in range(10)])
    assert len(got) == 30 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 for r in got)
    assert ew.identity_error(frame(spark, [(1, [0.5, -0.25, 1.0])] * 10), model) == 1.0
    model, got = run(spark, [(1, [0.0, 0.0, 3.0]), (2, [0.0, 0.0, 5.0])])
    assert sorted(round(r.whitened, 9) for r in got if r.component == 1) == [-1.0, 1.0]
    assert all(r.whitened == 0 for r in got if r.component > 1)
    assert len(run(spark, [(1, [2.0])])[1]) == 1
    assert run(spark, [(1, None)]) == (None, []) and run(spark, []) == (None, [])


def test_different_lengths_fail(spark):
    with pytest.raises(Exception, match="different numbers"):
        run(spark, [(1, [1.0, 2.0])] + [(2, [1.0, 2.0, 3.0])] * 2, parts=1)
    table = frame(spark, [(1, [1.0, 2.0])]).union(frame(spark, [(2, [1.0, 2.0, 3.0])]))
    with pytest.raises(Exception, match="different numbers"):
        ew.fit(table)


def test_deviation_limbs():
    rng = np.random.default_rng(1)
    for spread in (3, 2 ** 30, 2 ** 61):
        x = rng.integers(-spread, spread, (20, 3))
        sums = [sum(map(int, x[:, j])) for j in range(3)]
        model = ew.Whitening(20, tuple(sums), np.eye(3), np.ones(3), np.ones(3))
        assert model.deviations(x) == [sum((20 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
