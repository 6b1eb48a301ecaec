"""Top-k search against all inner products, whitening against numpy's eigenvectors and exact fractions."""
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.llm import charpoly, topk, whitening
from maplift.llm.kdtree import HIGHEST, LOWEST, KdTree, products
from maplift.llm.topk import exact_top_k
from maplift.llm.whitening import deviations, exact_products, whitened, whole

SCHEMA = "vec_id long, embedding array<double>, label int, query long, score string, n string, vec int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s", "n", 3) for i, v in rows], SCHEMA)


def awkward_vectors(rng, n=150, d=5):
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    copy = rows[3][1]
    rows += [(n + i, list(copy)) for i in range(60)]  # a group of copies
    rows += [(None, list(copy)), (None, [0.5] * d), (7, [0.25] * d), (7, [0.25] * d), (20, [9.0] * d), (500, None), (510, [None] + [1.0] * (d - 1)),
             (520, [float("nan")] * d), (530, [float("inf")] * d), (540, []), (550, [1.0]), (560, [0.0] * d), (570, [-0.0] * d)]
    return rows


def clean(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


# ------------------------------------------------------------------ search
def top_by_hand(rows, every, k):
    whole_rows = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in clean(rows)]
    out = Counter()
    for a, (i, u) in enumerate(whole_rows):
        if i is None or i % every:
            continue
        found = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(x * y for x, y in zip(u, v)))), HIGHEST if j is None else j)
                       for b, (j, v) in enumerate(whole_rows) if a != b)[:k]
        out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("shard_rows, least, leaf", [(1 << 16, 1 << 10, 64), (40, 40, 4), (7, 1, 1)])
def test_search_equals_all_products(spark, monkeypatch, shard_rows, least, leaf):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAST_ROWS", least)
    monkeypatch.setattr(KdTree.__init__, "__defaults__", (leaf,))
    rows = awkward_vectors(np.random.default_rng(5))
    got = exact_top_k(table(spark, rows), every=10, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == top_by_hand(rows, 10, 10)


def test_search_of_few_rows_and_large_numbers(spark):
    few = [(0, [1.0, 2.0]), (10, [3.0, -1.0]), (11, [0.5, 0.5])]
    assert Counter(map(tuple, exact_top_k(table(spark, few), every=10).collect())) == top_by_hand(few, 10, 10)
    large = [(i, [10.0 ** (i % 12), -float(i), 1e290 if i == 4 else 0.0]) for i in range(40)]
    assert Counter(map(tuple, exact_top_k(table(spark, large), every=10, k=5).collect())) == top_by_hand(large, 10, 5)
    assert exact_top_k(table(spark, []), every=10).count() == 0
    assert exact_top_k(table(spark, [(1, [1.0])]), every=10).count() == 0
    assert exact_top_k(table(spark, [(0, [1.0])]), every=10).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 90), st.integers(0, 4), st.integers(1, 12), st.sampled_from([1, 3, 1000, 10**7, 10**12]))
def test_tree_search_is_exact(seed, n, d, k, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, size=(n, d)).astype(float)
    ids, rows = rng.permutation(n) * 3, np.arange(n)
    q = np.vstack([x[: n // 2], rng.integers(-size, size + 1, size=(3, d)).astype(float)])
    own = np.append(rows[: n // 2], [-1, -1, -1])
    best, who = KdTree(x, ids, rows, leaf=4).search(q, own, k, np.full(len(q), LOWEST), np.full(len(q), HIGHEST))
    for a in range(len(q)):
        all_ = sorted((-max(min(sum(int(u) * int(v) for u, v in zip(q[a], x[b])), HIGHEST), LOWEST + 1), int(ids[b])) for b in range(n) if b != own[a])[:k]
        assert [(-s, i) for s, i in zip(best[a].tolist(), who[a].tolist()) if s != LOWEST] == all_


def test_tree_leaves_most_vectors_unread():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(40, 1, 3)) * 5 + rng.normal(size=(40, 50, 3)) * 0.1)).reshape(-1, 3)
    tree = KdTree(x, np.arange(2000), np.arange(2000), leaf=8)
    read = []
    import maplift.llm.kdtree as module
    plain = module.products
    try:
        module.products = lambda q, y: read.append(len(y) if y is not None and y.shape[1] == 3 else 0) or plain(q, y)
        tree.search(x[:1], np.array([0]), 10, np.array([LOWEST]), np.array([HIGHEST]))
    finally:
        module.products = plain
    assert sum(read) < 400


@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=2), min_size=1, max_size=4))
def test_products_are_exact(rows):
    x = np.floor(np.array(rows) * 2.0**20)
    assert products(x, x).tolist() == [[max(-2**63 + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v)))) for v in x] for u in x]


# ------------------------------------------------------------------ whitening
def exact_moments(rows):
    d = max(len(v) for _, v in rows)
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    m = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return x, n, s, m


def check_whitened(got, rows, most=32):
    rows = clean(rows)
    x, n, s, m = exact_moments(rows)
    value, vector = np.linalg.eigh(np.array(m, float) / n / n)
    value, vector = value[::-1], vector[:, ::-1]
    rank = min(most, int((value > 1e-9 * value[0]).sum()))
    assert len(got) == rank * len(rows)
    dev = Counter((i, sum((n * c - t) ** 2 for c, t in zip(r, s))) for (i, _), r in zip(rows, x))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == dev
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    w = np.array([[c - Fraction(t, n) for c, t in zip(r, s)] for r in x], float)
    for k in range(rank):
        mine = [r for r in got if r.component == k + 1]
        assert mine[0].explained == pytest.approx(value[k] / value.sum(), rel=1e-9)
        gap = min([abs(value[k] - value[j]) for j in range(len(value)) if j != k], default=value[0])
        if gap < 1e-6 * value[0]:
            continue
        expect = w @ vector[:, k] / math.sqrt(value[k])
        key = sorted(zip([-1 if i is None else i for i, _ in rows], expect.tolist()))
        have = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in mine)
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(key, have)))
        sides = sorted((i, sign * v) for i, v in key)
        assert [i for i, _ in sides] == [i for i, _ in have]
        np.testing.assert_allclose([v for _, v in have], [v for _, v in sides], rtol=1e-7, atol=1e-7)


def test_whitening_equals_numpy(spark):
    rows = awkward_vectors(np.random.default_rng(8), d=7)
    df = table(spark, rows).repartition(3)
    check_whitened(whitened(df).collect(), rows)
    check_whitened(whitened(df, most=2).collect(), rows, most=2)


def test_whitening_of_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check_whitened(whitened(df).collect(), [(r.vec_id, list(r.embedding)) for r in df.collect()])


def test_whitening_of_degenerate_tables(spark):
    assert whitened(table(spark, [])).count() == 0
    assert whitened(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    assert whitened(table(spark, [(1, []), (2, [])])).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    check_whitened(whitened(table(spark, line)).collect(), line)
    # equal eigenvalues: any basis of their space, still uncorrelated and of unit variance
    cross = [(i, [float(s * (i % 3 == j)) for j in range(3)]) for i in range(3) for s in (-1, 1)]
    got = whitened(table(spark, cross)).collect()
    assert len(got) == 18 and got[0].identity_error < 1e-9
    assert {round(r.explained, 12) for r in got} == {round(1 / 3, 12)}
    huge = [(i, [(-1.0) ** i * 10.0 ** (i % 18), 1e300 if i == 2 else float(i)]) for i in range(20)]
    got = whitened(table(spark, huge)).collect()
    assert len(got) == 40 and got[0].identity_error < 1e-4


def test_too_many_dimensions_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIM", 3)
    sums = whitening.Sums()
    with pytest.raises(ValueError, match="at most 3"):
        sums.add(np.zeros((2, 4)))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.integers(0, 2**32), st.sampled_from([2, 50, 10**9, 10**30]))
def test_characteristic_polynomial_is_exact(d, seed, size):
    rng = np.random.default_rng(seed)
    a = [[int(v) * (size // 2 or 1) // 1000 for v in r] for r in rng.integers(-1000, 1001, size=(d, d))]
    if seed % 3 == 0:
        a[0] = list(a[-1])  # singular, and zeros below the diagonal on the way
    res = [(p, charpoly.charpoly_mod(np.array([[v % p for v in r] for r in a], np.int64), p).tolist())
           for p in charpoly.primes(charpoly.primes_needed(a))]
    # Faddeev-LeVerrier, in fractions
    c, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    assert charpoly.remaindered(res) == [int(v) for v in reversed(c)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=8))
def test_roots_with_multiplicity(roots):
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for t in {0, *roots, *(r - 1 for r in roots if r)}:
        assert charpoly.roots_above(poly, t, 0) == sum(r > t for r in roots)
    ordered = sorted((r for r in roots if r), reverse=True)
    for k, r in enumerate(ordered):
        low, high, bits, n = charpoly.root_interval(poly, k, max(roots))
        assert low < r << bits <= high and n == ordered.count(r)


@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=3, max_size=3), min_size=1, max_size=5))
def test_sums_and_deviations_are_exact(rows):
    y = whole(np.array(rows))
    exact = [[int(v) for v in r] for r in y]
    assert exact_products(y).tolist() == [[sum(r[i] * r[j] for r in exact) for j in range(3)] for i in range(3)]
    sums = whitening.Sums()
    sums.add(y)
    t = sums.table().to_pylist()
    value = {(r["i"], r["j"]): sum(r[f"l{k}"] << (30 * k) for k in range(5)) for r in t}
    assert value[-2, 0] == len(y) and [value[-1, j] for j in range(3)] == [sum(c) for c in zip(*exact)]
    assert all(value[i, j] == sum(r[i] * r[j] for r in exact) for i in range(3) for j in range(i, 3))
    s = [sum(c) for c in zip(*exact)]
    _, squares = deviations(y, len(y), s)
    assert squares.tolist() == [min(2**63 - 1, sum((len(y) * v - t) ** 2 for v, t in zip(r, s))) for r in exact]
