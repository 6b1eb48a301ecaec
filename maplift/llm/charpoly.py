"""Spectra of integer matrices without floating point: characteristic polynomial, its real roots, null vectors.

The polynomial of an integer matrix has integer coefficients.  Modulo a prime it comes from the Hessenberg form,
which takes exact row and column operations; enough primes give the integers by Chinese remaindering (their number
follows from a bound of the coefficients).  All roots of a symmetric matrix are real, so by Descartes' rule
of signs the sign changes of p(x + t) count the roots above t exactly, with multiplicity: bisection isolates
the k-th root to any precision.  A component is the null vector of M - root, found by inverse iteration in
fixed-point integers.
"""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

#: Bits to which roots are isolated, relative to the largest; fixed-point bits of the inverse iteration.
ROOT_BITS, WORK_BITS = 192, 448


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # decides every n below 3,215,031,751
        x = pow(a, d, n)
        if x in (1, n - 1) or a % n == 0:
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return n > 1


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2**31: products of two residues fit 64-bit integers."""
    out, n = [], 2**31 - 1
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def primes_needed(matrix: list[list[int]]) -> int:
    """Enough primes for coefficients of either sign: |c_k| <= sum over k-subsets of products of row norms, <= prod(1 + norm)."""
    bits = sum(math.isqrt(sum(x * x for x in row)).bit_length() + 1 for row in matrix)
    return (bits + 2) // 30 + 1  # each prime has more than 30 bits


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """det(x I - M) modulo p by Hessenberg reduction; coefficients from the constant up.  ``matrix``: residues, int64."""
    h, n = matrix.astype(np.int64) % p, len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m], :] = h[[m, i], :]
            h[:, [i, m]] = h[:, [m, i]]
        inverse = pow(int(h[m, m - 1]), -1, p)
        u = h[m + 1:, m - 1] * inverse % p
        h[m + 1:, :] = (h[m + 1:, :] - u[:, None] * h[m, :] % p) % p
        # column m gains sum(u_i * column i): products are reduced one by one, their sum stays below 2**31 * n
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(1, n + 1):
        poly = np.zeros(k + 1, np.int64)
        poly[1:] = polys[k - 1]
        poly[:k] = (poly[:k] - int(h[k - 1, k - 1]) * polys[k - 1] % p) % p
        t = 1
        for i in range(1, k):
            t = t * int(h[k - i, k - i - 1]) % p
            if not t:
                break
            c = t * int(h[k - i - 1, k - 1]) % p
            poly[: k - i] = (poly[: k - i] - c * polys[k - i - 1] % p) % p
        polys.append(poly)
    return polys[n]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Integers (of either sign) from their residues modulo several primes, by mixed radix."""
    found, modulus = [0] * len(residues[0][1]), 1
    for p, r in residues:
        inverse = pow(modulus % p, -1, p)
        found = [f + modulus * ((x - f) * inverse % p) for f, x in zip(found, r)]
        modulus *= p
    return [f - modulus if f > modulus // 2 else f for f in found]


# ------------------------------------------------------------------ roots
def roots_above(poly: list[int], num: int, bits: int) -> int:
    """Roots greater than num / 2**bits, with multiplicity, of a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [x << (bits * (d - k)) for k, x in enumerate(poly)] if bits >= 0 else [x << (-bits * k) for k, x in enumerate(poly)]
    # the roots of c are the roots of poly times 2**bits; shift by num (Horner's scheme)
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += num * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(poly: list[int], num: int, bits: int) -> int:
    v, scale = 0, 0
    for x in reversed(poly):
        v = v * num + (x << scale)
        scale += bits
    return (v > 0) - (v < 0)


def root_interval(poly: list[int], k: int, top: int) -> tuple[int, int, int, int]:
    """(low, high, bits, number): the k-th greatest root (from 0), which is positive, lies in (low, high] / 2**bits.

    ``top``: no root is greater.  The interval has ROOT_BITS relative bits; ``number`` counts the roots in it:
    those equal, or not told apart at this precision."""
    low, high, bits = 0, 1 << (top.bit_length() + 1), 0
    above_low, above_high = roots_above(poly, 0, 0), 0
    while not low or high.bit_length() - (high - low).bit_length() < ROOT_BITS:
        if high - low == 1:
            low, high, bits = low * 2, high * 2, bits + 1
        mid = (low + high) // 2
        if above_low - above_high == 1:  # one simple root is left: the signs tell the side
            at_high = _value_sign(poly, high, bits)
            left = at_high != 0 and _value_sign(poly, mid, bits) in (0, at_high)
            n = above_high if left else above_low
        else:
            n = roots_above(poly, mid, bits)
            left = n <= k
        if left:
            high, above_high = mid, n
        else:
            low, above_low = mid, n
    return low, high, bits, above_low - above_high


# ------------------------------------------------------------------ components
def _solve(a: list[list[int]], b: list[list[int]], bits: int) -> list[list[int]]:
    """X with A X = B in fixed point, partial pivoting; a vanishing pivot counts as one unit."""
    n = len(a)
    m = np.array([[*r, *s] for r, s in zip(a, b)], object)
    for c in range(n):
        piv = max(range(c, n), key=lambda r: abs(m[r, c]))
        if piv != c:
            m[[c, piv]] = m[[piv, c]]
        if not m[c, c]:
            m[c, c] = 1
        if c + 1 < n:
            f = (m[c + 1:, c] << bits) // m[c, c]
            m[c + 1:, c:] -= (f[:, None] * m[c, c:][None, :]) >> bits
    x = m[:, n:]
    for c in range(n - 1, -1, -1):
        x[c] = (x[c] << bits) // m[c, c]
        if c:
            x[:c] -= (m[:c, c][:, None] * x[c][None, :]) >> bits
    return x.tolist()


def null_vectors(matrix: list[list[int]], low: int, high: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors v with M v = root v, for the ``count`` roots of one interval, by inverse iteration."""
    n = len(matrix)
    size = max(max((abs(x) for r in matrix for x in r), default=0).bit_length(), 1)
    w = WORK_BITS
    root = ((low + high) << (w - 1 - size)) >> bits if w - 1 - size >= 0 else (low + high) >> (bits + 1 + size - w)
    a = [[((x << w) >> size) - (root if i == j else 0) for j, x in enumerate(r)] for i, r in enumerate(matrix)]
    rng = np.random.default_rng(13)  # any start that is not orthogonal to the null space
    x = [[int(v) << (w - 20) for v in r] for r in rng.integers(1, 1 << 20, size=(n, count))]
    for _ in range(3):
        x = _orthonormal(_solve(a, x, w), w)
    return [[_float(x[i][c], w) for i in range(n)] for c in range(count)]


def _float(x: int, bits: int) -> float:
    return float(Fraction(x, 1 << bits))


def _orthonormal(x: list[list[int]], w: int) -> list[list[int]]:
    cols = [list(c) for c in zip(*x)]
    out: list[list[int]] = []
    for c in cols:
        top = max(abs(v) for v in c).bit_length()
        c = [(v << w) >> top for v in c]
        for _ in range(2):
            for o in out:
                dot = sum(u * v for u, v in zip(o, c)) >> w
                c = [v - ((dot * u) >> w) for u, v in zip(o, c)]
        norm = math.isqrt(sum(v * v for v in c)) or 1
        out.append([(v << w) // norm for v in c])
    return [list(r) for r in zip(*out)]
