"""Words, word hashes and n-gram hashes of many texts at once, on UTF-8 bytes in numpy.

Two kinds of words:

* ``space``: runs of anything but the six ASCII white-space characters;
* ``alnum``: runs of ASCII letters, digits and all non-ASCII characters.

Hashes are 64-bit.  A word's hash is a multilinear sum over its bytes with
one multiplier per position, then mixed; n-grams mix the word hashes in order.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, three rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


_POWERS = [_stream(1024, 11) | U(1)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = _stream(2 * n, 11) | U(1)
    return _POWERS[0]


def _tables(kind: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256)
    if kind == "space":
        word = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    else:
        word = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    folded = np.where((b >= 0x41) & (b <= 0x5A), b + 32, b) if lower else b
    return word, _stream(256, 5)[folded]


_TABLES = {(k, lo): _tables(k, lo) for k in ("space", "alnum") for lo in (True, False)}


@dataclass
class Words:
    """Words of a slice of texts: hash, byte span and the first word of each text."""
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1


def words_of(buf: np.ndarray, off: np.ndarray, kind: str = "space", lower: bool = True) -> Words:
    is_word, value = _TABLES[kind, lower]
    iw = is_word[buf]
    start = iw.copy()
    start[1:] &= ~iw[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    start[heads] = iw[heads]
    last = iw.copy()
    last[:-1] &= ~iw[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    if not len(s):
        return Words(np.zeros(0, np.uint64), s, e, np.zeros(len(off), np.int64))
    size = e - s
    at = np.zeros(len(s), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    chars = value[buf[iw]]
    rel = np.arange(len(chars), dtype=np.int64)
    rel -= np.repeat(at, size)
    chars *= _powers(int(size.max()))[rel]
    h = mix(np.add.reduceat(chars, at) + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return Words(h, s, e, np.searchsorted(s, off))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two hashed sequences (order matters)."""
    return mix(a * U(0x9FB21C651E98DF25) + (b ^ (b >> U(29))) + U(0x632BE59BD9B4E019))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by doubling; empty when there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, power, out, done = 1, h, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = power, size
            else:
                m = min(len(out), len(power) - done)
                out = join_hash(out[:m], power[done: done + m])
                done += size
        size *= 2
        if size > n:
            return out[: len(h) - n + 1]
        power = join_hash(power[: len(power) - size // 2], power[size // 2:])


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text.

    A text of fewer words is one shingle (its whole sequence); one without words has none.
    """
    grams = ngrams(w.hash, n)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(grams[lo: hi - n + 1]))
        elif hi > lo:
            out.append(mix(ngrams(w.hash[lo:hi], hi - lo) + U(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(u: np.ndarray) -> bytes:
    """128-bit identity of a set of hashes."""
    with np.errstate(over="ignore"):
        a = mix(u ^ U(0xA24BAED4963EE407)).sum(dtype=np.uint64) + U(len(u))
        b = mix(u + U(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64) ^ U(len(u))
        return np.array([a, b]).tobytes()
