"""Parity sketches of sets of hashes: what tells most unlike sets apart without their elements.

A set's elements flip bits of a string; the elements that two sets share flip the same bits, so the
sketches of two sets differ in at most as many bits as the sets differ in elements.  Sets whose sketches
differ in more bits than similar sets can differ in are not similar; the others have to be compared.

A sketch has at least as many bits as the set has elements, a power of two of them, and folds to the
length of a shorter one.
"""
from __future__ import annotations

import numpy as np

from maplift.llm.wordhash import U, mix

#: Bits of the smallest sketch.
LEAST_BITS = 64
#: Bytes that one comparison of sketches works on at a time.
CHUNK_BYTES = 1 << 20


def sketch(u: np.ndarray) -> bytes:
    """Sketch of a set of distinct hashes."""
    bits = max(LEAST_BITS, 1 << (max(len(u), 1) - 1).bit_length())
    at = (mix(u ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _rows(sketches: list[bytes], which: np.ndarray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join([sketches[i] for i in which.tolist()]), np.uint64).reshape(len(which), size // 8)


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _few(distance: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of a and b elements that differ in so many at least may have a Jaccard similarity of num / den."""
    return np.maximum(distance, np.abs(a - b)) * (den + num) <= (a + b) * (den - num)


def _classes(sketches: list[bytes]) -> list[tuple[int, np.ndarray]]:
    n = np.array([len(s) for s in sketches], np.int64)
    return [(int(x), np.flatnonzero(n == x)) for x in np.unique(n)]


def pairs_near(a: list[bytes], a_size: np.ndarray, b: list[bytes], b_size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of the pairs (a[i], b[i]), those that may reach the Jaccard similarity num / den."""
    out = np.zeros(len(a), bool)
    length = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(length, axis=0).tolist():
        at = np.flatnonzero((length == (la, lb)).all(axis=1))
        width, step = min(la, lb) // 8, max(1, CHUNK_BYTES // max(la, lb))
        for lo in range(0, len(at), step):
            i = at[lo: lo + step]
            x = _folded(_rows(a, i, la), width) ^ _folded(_rows(b, i, lb), width)
            out[i] = _few(np.bitwise_count(x).sum(axis=1, dtype=np.int64), a_size[i], b_size[i], num, den)
    return out


def any_near(a: list[bytes], a_size: np.ndarray, a_group: np.ndarray, b: list[bytes], b_size: np.ndarray,
             b_group: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a, and which of b, may be similar to one of another group on the other side."""
    left, right = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for la, i in _classes(a):
        for lb, j in _classes(b):
            if min(a_size[i].max(), b_size[j].max()) * den < max(a_size[i].min(), b_size[j].min()) * num:
                continue
            width = min(la, lb) // 8
            x, y = _folded(_rows(a, i, la), width), _folded(_rows(b, j, lb), width)
            step = max(1, CHUNK_BYTES // (8 * len(j)))
            for lo in range(0, len(i), step):
                k = i[lo: lo + step]
                distance = np.zeros((len(k), len(j)), np.int64)
                for w in range(width):
                    distance += np.bitwise_count(x[lo: lo + step, w, None] ^ y[None, :, w])
                near = _few(distance, a_size[k][:, None], b_size[j][None, :], num, den)
                near &= a_group[k][:, None] != b_group[j][None, :]
                left[k] |= near.any(axis=1)
                right[j] |= near.any(axis=0)
    return left, right
