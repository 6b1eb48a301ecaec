"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams (4 to 6 code points of the lower-cased text, runs of ASCII
punctuation read as one blank), counted once per document.  From the labelled sample each slot gets the ratio

    r = log((d1 + a * p1) / (p1 * (n + a))) - log((d0 + a * p0) / (p0 * (n + a)))

(d: documents of the class with the slot, p: share of the class), smoothed towards
zero, so that slots seen in few documents say little.  The slots whose class counts differ by more than ``MIN_Z``
standard errors are kept and a logistic regression is fitted on the scaled features
x * r in numpy.  Scoring adds the weights of the kept slots found in a whole text.

Defined results: null and empty texts get the score of no features; a document with a null
doc_id is scored and not held out; repeated rows are scored alike; rows with a null
or other label are not used; without training rows of both classes every score
is 0 (nothing is known to be toxic); extra columns are ignored or kept.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from maplift.llm.common import carried, prepare, restored, slices
from maplift.llm.labelled import labelled_sample
from maplift.llm.wordhash import U, mix

#: Most labelled rows that are used for training.
SAMPLE = 20_000
SIZES, BITS = (4, 5, 6), 18
SMOOTH, MIN_Z, KEEP = 4.0, 4.0, 1 << 14
#: Code points worked on at a time; longer texts are taken in overlapping pieces.
PIECE = 1 << 17


#: ASCII characters other than letters and digits read as a blank.
_BLANK = np.array([not chr(i).isalnum() for i in range(128)])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, lower-cased, runs of ASCII punctuation and space as one blank; ends of the texts)."""
    texts = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    ends = np.cumsum([len(t) for t in texts])
    low = chars < 128
    blank = np.zeros(len(chars), bool)
    blank[low] = _BLANK[chars[low]]
    chars[blank] = 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[ends[:-1]] = True  # each text starts with a blank of its own
    return chars[keep], np.cumsum(keep)[ends - 1]


def gram_slots(texts: list[str], index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, slot) pairs of all n-grams; ``index`` maps slots to kept features (or -1)."""
    chars, ends = letters(texts)
    found = []
    for lo in range(0, len(chars), PIECE):
        c = chars[lo: lo + PIECE + max(SIZES) - 1].astype(np.uint64)
        g = c.copy()
        for n in range(2, max(SIZES) + 1):
            g = g[:-1] * U(0x9E3779B97F4A7C15) + c[n - 1:]
            if n not in SIZES or not len(g):
                continue
            m = g[:PIECE]
            slot = (mix(m + U(n)) >> U(64 - BITS)).astype(np.int64)
            at = np.arange(lo, lo + len(m))
            if index is not None:
                slot = index[slot]
                keep = slot >= 0
                slot, at = slot[keep], at[keep]
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            found.append(np.unique(doc[inside] << BITS | slot[inside]))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class ToxicityModel:
    """``index``: kept feature of each slot or -1; ``weight``: one per kept feature; ``bias``."""
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        doc, feature = gram_slots(texts, self.index)
        z = self.bias + np.bincount(doc, self.weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


NOTHING_KNOWN = ToxicityModel(np.full(1 << BITS, -1), np.zeros(1), -40.0)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each class with a slot, documents of each class), summed from tasks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for b in slices(batch, limit=PIECE):
                label = b.column(0).to_numpy()
                doc, slot = gram_slots(b.column(1).to_pylist())
                total += np.bincount(label[doc] * (1 << BITS) + slot, minlength=2 << BITS).reshape(2, -1)
                n += np.bincount(label, minlength=2)
        if n.sum():
            yield pa.record_batch([pa.array([zlib.compress(total.astype(np.int32).tobytes(), 1)], pa.binary()),
                                   pa.array([n[0]]), pa.array([n[1]])], names=["t", "n0", "n1"])
    total, n = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in sample.mapInArrow(run, "t binary, n0 long, n1 long").collect():  # one row of fixed size per sample file
        total += np.frombuffer(zlib.decompress(r.t), np.int32).reshape(2, -1)
        n += (r.n0, r.n1)
    return total, n


def fit_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicityModel:
    prepare(documents.sparkSession)
    sample = labelled_sample(documents, labels, label, bound)
    d, n = _counts(sample)
    if not n.all():
        return NOTHING_KNOWN
    share = n / n.sum()
    ratio = np.log((d[1] + SMOOTH * share[1]) / share[1]) - np.log((d[0] + SMOOTH * share[0]) / share[0])
    p = d.sum(axis=0) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(d[1] / n[1] - d[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    z = np.nan_to_num(z, posinf=0)
    kept = np.argsort(-z, kind="stable")[:KEEP]
    kept = kept[z[kept] >= MIN_Z]
    if not len(kept):
        kept = np.argsort(-z, kind="stable")[:256]
    index = np.full(1 << BITS, -1)
    index[kept] = np.arange(len(kept))
    known = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=PIECE):
                doc, f = gram_slots(b.column(1).to_pylist(), known.value)
                at = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))],
                                      names=["label", "f"])
    rows = sample.mapInArrow(run, "label int, f array<int>").toArrow()  # at most ``bound`` rows of kept features
    f = rows.column("f").combine_chunks()
    weight, bias = _regression(np.array(rows.column("label")), f.flatten().to_numpy(),
                               np.array([len(x) for x in f]), ratio[kept], len(kept))
    return ToxicityModel(index, weight, bias)


def _regression(y: np.ndarray, f: np.ndarray, size: np.ndarray, ratio: np.ndarray, k: int,
                steps: int = 300, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on x * ratio by full-batch Adam; returns weights already scaled by the ratio."""
    row = np.repeat(np.arange(len(y)), size)
    w, b, base = np.full(k, 0.1), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))), ratio[f]
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(row, w[f] * base, minlength=len(y)), -40, 40)
        e = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(f, e[row] * base, minlength=k) / len(y) + l2 * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w * ratio, float(b)


def _scored(df: DataFrame, model) -> DataFrame:
    """``carried`` rows with the score of each whole text."""
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            filled = batch.set_column(1, "text", batch.column(1).fill_null(""))
            done = 0
            for b in slices(filled, limit=PIECE):
                part = batch.slice(done, b.num_rows)
                done += b.num_rows
                got = model.score(b.column(1).to_pylist())
                yield pa.record_batch([*part.columns, pa.array(got, pa.float64())], names=["rest", "text", "doc_id", "score"])
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))


def scored(documents: DataFrame, model) -> DataFrame:
    """All columns of ``documents`` and the score of each whole text; works on any model with ``score(texts)``."""
    return restored(_scored(carried(documents), model), documents.columns, "score")


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, all columns kept."""
    model = fit_toxicity(documents, labels)
    return restored(_scored(carried(documents), model).where(F.col("score") < threshold), documents.columns)
