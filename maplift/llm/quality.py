"""Quality: supervised subword embeddings averaged per document, softmax output, numpy SGD.

A document has three groups of features, hashed to slots:

* its words (runs of anything but ASCII white space, letter case kept);
* its character n-grams (3 and 4 code points, blanks included);
* for each word, how far back the same word occurred last (powers of two, or never), which
  tells running text from the same words repeated.

Every slot has a learned vector; a document is the sum over the groups of the mean vector of
its features, and a softmax layer gives the probability of label 1.  Vectors and layer are
learned by stochastic gradient descent, document by document, on a bounded labelled sample.
The layer is linear in the vectors, so for scoring each slot is reduced to one number
(vector times difference of the two output rows), which gives the same probability.

Defined results: null and empty texts are scored by the bias alone; a document with a null
doc_id is scored and not held out; repeated rows are scored alike; rows with a null or other
label are not used; without training rows of both classes every score is 1 (nothing is
known to be bad); extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maplift.llm.common import prepare, slices
from maplift.llm.labelled import labelled_sample
from maplift.llm.wordhash import U, mix, words_of

#: Most labelled rows that are used for training.
SAMPLE = 4_000
BITS, SIZES, GAPS = 17, (3, 4), 32
WORDS, GRAMS, GAP = 0, 1 << BITS, 2 << BITS  # first slot of each group
SLOTS = GAP + GAPS
DIM, EPOCHS, RATE = 8, 12, 0.5
PIECE = 1 << 19


def feature_slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, slot) of all features of whole texts, in parts of bounded size."""
    raw = [t.encode() for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    w = words_of(np.frombuffer(b"".join(raw), np.uint8), off, "space", lower=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    yield doc, (w.hash >> U(64 - BITS)).astype(np.int64) + WORDS
    order = np.argsort(w.hash ^ mix(doc.astype(np.uint64)), kind="stable")
    same = (w.hash[order][1:] == w.hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    gap = np.full(len(order), GAPS - 1)
    back = np.diff(order)[same]
    gap[1:][same] = np.minimum(np.log2(back).astype(np.int64), GAPS - 2)
    yield doc[order], gap + GAP
    padded = [f" {t} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in padded])
    for lo in range(0, len(chars), PIECE):
        c = chars[lo: lo + PIECE + max(SIZES) - 1].astype(np.uint64)
        g = c
        for n in range(2, max(SIZES) + 1):
            g = g[:-1] * U(0x9E3779B97F4A7C15) + c[n - 1:]
            if n in SIZES and len(g):
                m = g[:PIECE]
                at = np.arange(lo, lo + len(m))
                d = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[d]
                yield d[inside], (mix(m[inside] + U(n)) >> U(64 - BITS)).astype(np.int64) + GRAMS


def _group(slot: np.ndarray) -> int:
    return 0 if slot[0] < GRAMS else 1 if slot[0] < GAP else 2


@dataclass
class QualityModel:
    """``value``: per slot, its vector times the difference of the output rows; ``bias``."""
    value: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros((3, len(texts))), np.zeros((3, len(texts)))
        for doc, slot in feature_slots(texts):
            if len(slot):
                g = _group(slot)
                total[g] += np.bincount(doc, self.value[slot], minlength=len(texts))
                count[g] += np.bincount(doc, minlength=len(texts))
        z = self.bias + (total / np.maximum(count, 1)).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


NOTHING_KNOWN = QualityModel(np.zeros(SLOTS), 40.0)


def _features(sample: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, distinct slots, share of each within its group) of the sampled texts, extracted by tasks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1):
                parts = {0: [], 1: [], 2: []}
                for _, slot in feature_slots(b.column(1).to_pylist()):
                    if len(slot):
                        parts[_group(slot)].append(slot)
                slots, shares = [], []
                for p in parts.values():
                    if p:
                        s, n = np.unique(np.concatenate(p), return_counts=True)
                        slots.append(s)
                        shares.append(n / n.sum())
                slots = np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int32)
                yield pa.record_batch([b.column(0), pa.array([slots.tobytes()], pa.binary()),
                                       pa.array([np.concatenate([np.zeros(0), *shares]).astype(np.float32).tobytes()],
                                                pa.binary())], names=["label", "slots", "shares"])
    rows = sample.mapInArrow(run, "label int, slots binary, shares binary").collect()  # at most ``bound`` rows
    return [(r.label, np.frombuffer(r.slots, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows]


def fit_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> QualityModel:
    prepare(documents.sparkSession)
    rows = sorted(_features(labelled_sample(documents, labels, label, bound)), key=lambda r: (r[1].tobytes(), r[0]))
    if len({r[0] for r in rows}) < 2:
        return NOTHING_KNOWN
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (SLOTS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, slots, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[slots]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the softmax loss
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            vectors[slots] -= rate * share[:, None] * back
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))
