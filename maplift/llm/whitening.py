"""Embedding whitening on exact integers.

Entries c become integers x = floor(64 c) + 1000000.  With n vectors and sums S the scatter n * sum(x x') - S S' is an
integer matrix, n * n times the covariance, and the same for x without its constant.

1. Tasks sum their vectors' products exactly (in doubles below 2**53, in 21-bit limbs beyond), Spark adds the sums.
2. Tasks reduce the scatter to Hessenberg form modulo one prime each; Chinese remaindering gives the characteristic
   polynomial as integers (``charpoly``).
3. One task per component isolates its root by exact counts and finds the null vector by inverse iteration.
4. Rows are projected; the covariance of what comes out is measured in a pass of its own.

Only sums of d * d entries reach the driver (d: dimensions, at most ``MAX_DIM``, else ValueError), never vectors.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; a shorter vector
counts as ended by zeros; rows with a null or repeated vec_id are rows like others; floor(64 c) is held within
+-2**62 and ``deviation`` within a long.  Components of eigenvalue 0 have no scale and are not returned, so
equal vectors, a single vector or an empty table give no rows.  For an eigenvalue that occurs several times any
orthonormal components of its space are given.  Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm import charpoly
from maplift.llm.common import prepare
from maplift.llm.vectors import finite_vectors, padded

SCALE, MAX_DIM, COMPONENTS = 64, 1024, 32
_EDGE = float(2**62)
LIMB, LIMBS = 30, 5  # sums travel as limbs of 30 bits, the last one signed and open


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c), as exact doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -_EDGE, _EDGE)


# ------------------------------------------------------------------ scatter
def exact_products(y: np.ndarray) -> np.ndarray:
    """Y' Y in exact integers (int64, or Python integers where those do not fit); at most 2048 rows."""
    top = np.abs(y).max(initial=0)
    if top < 2**21:
        return (y.T @ y).astype(np.int64)
    limbs, rest = [], y
    while np.any(rest):
        high = np.floor(rest / 2**21)
        limbs.append(rest - high * 2**21)
        rest = high
        if len(limbs) == 3:
            break
    limbs = [*limbs[:2], limbs[2] + rest * 2**21] if len(limbs) == 3 else limbs
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (21 * (i + j))
    return total


class Sums:
    """Exact sums of the vectors of one task."""

    def __init__(self):
        self.n, self.rows = 0, 0
        self.products, self.exact = np.zeros((0, 0), np.int64), np.zeros((0, 0), object)
        self.total = np.zeros(0, object)

    def add(self, y: np.ndarray) -> None:
        self._widen(y.shape[1])
        d = y.shape[1]
        for lo in range(0, len(y), 1024):
            part = y[lo: lo + 1024]
            self.n += len(part)
            self.total[:d] += np.array([int(s) for s in part.sum(axis=0)] if np.abs(part).max(initial=0) < 2**42
                                       else [sum(map(int, c)) for c in part.T], object)
            got = exact_products(part)
            if got.dtype == object:
                self.exact[:d, :d] += got
                continue
            self.products[:d, :d] += got
            self.rows += len(part)
            if self.rows >= 1 << 19:  # each product is below 2**42
                self._settle()

    def _widen(self, d: int) -> None:
        more = d - len(self.total)
        if more > 0:
            if d > MAX_DIM:
                raise ValueError(f"vectors of {d} dimensions; whitening takes at most {MAX_DIM}")
            old = len(self.total)
            products, exact, total = self.products, self.exact, self.total
            self.products, self.exact, self.total = np.zeros((d, d), np.int64), np.zeros((d, d), object), np.zeros(d, object)
            self.products[:old, :old], self.exact[:old, :old], self.total[:old] = products, exact, total

    def _settle(self) -> None:
        self.exact = self.exact + self.products.astype(object)
        self.products[:], self.rows = 0, 0

    def table(self) -> pa.RecordBatch:
        """(i, j, limbs): i -2: the number of vectors; -1: sums; else products, i <= j."""
        self._settle()
        d = len(self.total)
        i, j = np.triu_indices(d)
        left = np.concatenate([[-2], np.full(d, -1), i]).astype(np.int32)
        right = np.concatenate([[0], np.arange(d), j]).astype(np.int32)
        values = np.concatenate([np.array([self.n], object), self.total, self.exact[i, j]])
        limbs = []
        for _ in range(LIMBS - 1):
            limbs.append((values & ((1 << LIMB) - 1)).astype(np.int64))
            values = values >> LIMB
        limbs.append(values.astype(np.int64))
        return pa.record_batch([pa.array(left), pa.array(right), *map(pa.array, limbs)],
                               names=["i", "j", *(f"l{k}" for k in range(LIMBS))])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums()
    for b in batches:
        if b.num_rows:
            sums.add(whole(padded(b.column(0))))
    if sums.n:
        yield sums.table()


def scatter(vectors: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * sum(y y') - sums sums') of y = floor(64 c), exact."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.select("vec").mapInArrow(_summed, "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    rows = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in limbs)).collect()  # at most MAX_DIM ** 2 rows
    value = {(r.i, r.j): sum(r[c] << (LIMB * k) for k, c in enumerate(limbs)) for r in rows}
    n = value.get((-2, 0), 0)
    d = max((j for i, j in value if i == -1), default=-1) + 1
    s = [value[-1, j] for j in range(d)]
    return n, s, [[n * value[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ------------------------------------------------------------------ components
def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """det(x I - matrix), coefficients from the constant up: one task per prime, remaindered."""
    primes = charpoly.primes(charpoly.primes_needed(matrix))
    known = spark.sparkContext.broadcast(matrix)  # d * d integers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in (primes[i] for i in b.column(0).to_pylist()):
                residues = np.array([[x % p for x in r] for r in known.value], np.int64)
                found.append(charpoly.charpoly_mod(residues, p).tolist())
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "r"])
    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "id long, r array<long>").collect()  # d * primes integers
    return charpoly.remaindered([(primes[r.id], list(r.r)) for r in rows])


def components(spark, matrix: list[list[int]], most: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit component) by falling eigenvalue, of the positive ones, at most ``most``; one task each."""
    if not matrix:
        return []
    poly = characteristic_polynomial(spark, matrix)
    top = sum(matrix[i][i] for i in range(len(matrix)))
    n = min(most, charpoly.roots_above(poly, 0, 0))
    if not n:
        return []
    known = spark.sparkContext.broadcast((matrix, poly))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, poly = known.value
        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                low, high, bits, number = charpoly.root_interval(poly, k, top)
                v = charpoly.null_vectors(matrix, low, high, bits, number)[k - charpoly.roots_above(poly, high, bits)]
                sign = 1 if max(v, key=abs) > 0 else -1
                rows.append((k, f"{low + high}/{2 << bits}", [sign * x for x in v]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.float64())))],
                                  names=["id", "root", "v"])
    tasks = min(n, spark.sparkContext.defaultParallelism)
    rows = spark.range(0, n, 1, tasks).mapInArrow(run, "id long, root string, v array<double>").collect()  # at most ``most`` rows
    return [(Fraction(r.root), list(r.v)) for r in sorted(rows, key=lambda r: r.id)]


# ------------------------------------------------------------------ rows
def deviations(y: np.ndarray, n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n y - S as doubles, sum of its squares as longs); both exact before they are rounded or held within a long."""
    top = max((abs(v) for v in s), default=0) + n * int(np.abs(y).max(initial=0))
    if top * top * max(len(s), 1) < 2**63:
        dev = n * y.astype(np.int64) - np.array(s, np.int64)
        return dev.astype(float), (dev * dev).sum(axis=1)
    exact = n * np.array([[int(v) for v in r] for r in y], object).reshape(y.shape) - np.array(s, object)
    squares = np.minimum((exact * exact).sum(axis=1), 2**63 - 1)
    return exact.astype(float), squares.astype(np.int64)


def _projected(vectors: DataFrame, n: int, s: list[int], base: np.ndarray, finish, schema: str) -> DataFrame:
    """``finish`` applied to (ids, deviation, whitened) of each batch; ``base``: components over their scales."""
    known = vectors.sparkSession.sparkContext.broadcast((n, s, base))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, base = known.value

        def rows():
            for b in batches:
                if b.num_rows:
                    dev, squares = deviations(whole(padded(b.column(1), len(s))), n, s)
                    yield b.column(0), squares, (dev / n) @ base
        yield from finish(rows())
    return vectors.select("vec_id", "vec").mapInArrow(run, schema)


def _products(rows) -> Iterator[pa.RecordBatch]:
    total = None
    for _, _, w in rows:
        w = np.column_stack([np.ones(len(w)), w])  # sums beside products
        total = w.T @ w if total is None else total + w.T @ w
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())],
                              names=["i", "j", "x"])


def identity_error(vectors: DataFrame, n: int, s: list[int], base: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened rows (centred already) minus the identity."""
    k = base.shape[1]
    rows = (_projected(vectors, n, s, base, _products, "i int, j int, x double")
            .groupBy("i", "j").agg(F.sum("x").alias("x")).collect())  # (components + 1) ** 2 rows
    x = np.zeros((k + 1, k + 1))
    for r in rows:
        x[r.i, r.j] = r.x
    mean = x[0, 1:] / n
    return float(np.abs(x[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    prepare(spark)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    vectors = finite_vectors(table, id_col, vec_col)
    n, s, matrix = scatter(vectors)
    found = components(spark, matrix, most)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    base = np.array([[x / sqrt(root / (n * n)) for x in v] for root, v in found]).T
    explained = np.array([float(root / trace) for root, _ in found])
    error = identity_error(vectors, n, s, base)
    k = len(found)

    def explode(rows) -> Iterator[pa.RecordBatch]:
        for ids, squares, w in rows:
            m = len(w)
            yield pa.record_batch([
                ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(squares, k)), pa.array(w.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return _projected(vectors, n, s, base, explode, schema)
