"""Document fingerprints by SpotSigs.

A spot is a common word (anchor) of the text; its signature is the anchor with the next
``CHAIN`` content words (words that are no anchors).  A text's fingerprint is the set of its
signatures as 32-bit hashes; a text without spots has the chains of all its words
instead, so short or foreign texts are told apart too.  The likeness of two fingerprints is
their Jaccard similarity; two empty ones are alike.

``similar_documents`` is the near-duplicate join: fingerprints are partitioned by set length, so that
similar sets lie in the same or in neighbouring partitions; within a partition each set is
listed under the smallest n - ceil(n * t) + 1 of its signatures (similar sets share one), and sets under
one signature are compared exactly, sets too different in length not at all (``linking``).

``edited_likeness`` compares each text with a half-replaced one and with the next document.
Documents are sorted by doc_id in ranges, and each range also gets the first document of the next, so one
shuffle of the texts is enough and no range is held in memory.

Defined results: null text is empty; an empty text has the empty fingerprint ``''``; documents with a null
doc_id sort first; rows of one doc_id follow one another in the order of a hash of their text; extra columns
are ignored; an only document is its own next one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import prepare, slices, staged, text_bytes, texts_of
from maplift.llm.linking import forest, linked_groups, texts_by_doc
from maplift.llm.ngram_join import bands_of
from maplift.llm.wordhash import U, join_hash, mix, ngrams, set_id, words_of

CHAIN = 2
#: Anchors: common function words of English, German, French and Spanish (a parameter's default).
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "auf das den der des die ein in ist mit nicht und von zu "
    "avec dans de des du en est et la le les par pas pour que qui un une "
    "con de del el en es la las lo los no para por que se su un una y").split()
#: Range buckets for each shuffle partition, to even out their sizes.
BUCKETS_EACH = 4
#: Texts worked on at a time.
CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20


def _hashes(words: list[str]) -> np.ndarray:
    col = pa.array(words, pa.string())
    return words_of(*text_bytes(col), "alnum").hash


def spot_sets(col: pa.Array, anchors: np.ndarray, chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct signatures (uint32) of each text of a column without nulls; anchors: sorted hashes."""
    w = words_of(*text_bytes(col), "alnum")
    size = np.diff(w.first)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.searchsorted(anchors, w.hash)
    is_anchor = anchors[np.minimum(place, len(anchors) - 1)] == w.hash
    spot, content = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
    nxt = np.searchsorted(content, spot)
    whole = nxt + chain <= len(content)
    spot, nxt = spot[whole], nxt[whole]
    whole = doc[content[nxt + chain - 1]] == doc[spot] if len(spot) else whole[:0]
    spot, nxt = spot[whole], nxt[whole]
    value = mix(w.hash[spot])
    for i in range(chain):
        value = join_hash(value, w.hash[content[nxt + i]])
    key = np.unique(doc[spot].astype(np.uint64) << U(32) | value >> U(32))
    at = np.searchsorted(key >> U(32), np.arange(len(size) + 1).astype(np.uint64))
    low = (key & U(0xFFFFFFFF)).astype(np.uint32)
    out = [low[a:b] for a, b in zip(at[:-1], at[1:])]
    for i in np.flatnonzero((np.diff(at) == 0) & (size > 0)):
        h = w.hash[w.first[i]: w.first[i + 1]]
        out[i] = np.unique((ngrams(h, min(chain, len(h))) >> U(32)).astype(np.uint32))
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparing when their lengths rule out ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return inter / (len(a) + len(b) - inter)


def as_text(spots: np.ndarray) -> str:
    return spots.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(documents: DataFrame, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(doc_id, n_spots, fingerprint) of every whole text."""
    prepare(documents.sparkSession)
    known = np.unique(_hashes(list(anchors)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = spot_sets(b.column(1), known, chain)
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([as_text(s) for s in sets], pa.string())],
                                      names=["doc_id", "n_spots", "fingerprint"])
    return texts_of(documents).mapInArrow(run, "doc_id long, n_spots long, fingerprint string")


def similar_documents(documents: DataFrame, num: int = 80, den: int = 100, anchors: list[str] = ANCHORS) -> DataFrame:
    """(doc_id, group): the smallest doc_id reachable by links between fingerprints of likeness num/den or more."""
    prepare(documents.sparkSession)
    docs = texts_of(documents).where("doc_id is not null")
    known = np.unique(_hashes(list(anchors)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                keys, at, ids, sizes = [], [], [], []
                for i, s in enumerate(spot_sets(b.column(1), known)):
                    if not len(s):
                        continue
                    prefix = s[: len(s) - -(-len(s) * num // den) + 1].astype(np.uint64)
                    for band, _ in bands_of(len(s), num, den):
                        keys.append(mix(prefix + U((band + 1) << 40)))
                        at.append(np.full(len(prefix), i))
                    ids.append(set_id(s.astype(np.uint64)))
                    sizes.append((i, len(s)))
                if not keys:
                    continue
                at, where = np.concatenate(at), {i: j for j, (i, _) in enumerate(sizes)}
                row = pa.array([where[i] for i in at.tolist()])
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids, pa.binary()).take(row),
                                       pa.array([n for _, n in sizes], pa.int64()).take(row), b.column(0).take(pa.array(at))],
                                      names=["key", "node", "size", "rep"])
    rows = staged(docs.mapInArrow(run, "key long, node binary, size long, rep long")
                  .groupBy("key", "node", "size").agg(F.min("rep").alias("rep")), "spots")
    low = staged(rows.groupBy("node").agg(F.min("rep").alias("doc_id")), "spot-sets")

    def verify(a: list[bytes], at: list[str], b: list[bytes], bt: list[str]) -> list[tuple[bytes, bytes]]:
        def sets(nodes, texts):
            found = spot_sets(pa.array(texts, pa.string()), known)
            return {n: s for n, s in zip(nodes, found) if set_id(s.astype(np.uint64)) == n}
        left = sets(a, at)
        right = left if a is b else sets(b, bt)
        least = num / den
        return forest((x, y) for x, s in left.items() for y, t in right.items()
                      if (x < y or a is not b) and x != y and likeness(s, t, least) >= least)

    labels = linked_groups(rows.drop("rep"), texts_by_doc(docs, low), verify, num / den * (1 - 1e-9))
    group = low.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    group = group.join(group.groupBy("label").agg(F.min("doc_id").alias("group")), "label").select("node", "group")

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield pa.record_batch([b.column(0), pa.array([set_id(s.astype(np.uint64)) for s in spot_sets(b.column(1), known)],
                                                             pa.binary())], names=["doc_id", "node"])
    return (docs.mapInArrow(own, "doc_id long, node binary").join(group, "node", "left")
            .select("doc_id", F.coalesce("group", "doc_id").alias("group")))


# ------------------------------------------------------------------ edited texts
def _in_ranges(docs: DataFrame) -> DataFrame:
    """(bucket, tail, ord, h, doc_id, text): documents in ranges of doc_id, each followed by the next range's first (tail)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * BUCKETS_EACH
    keyed = docs.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    cuts = np.unique(np.array(keyed.approxQuantile("ord", [i / n for i in range(1, n)], 0.25 / n), np.float64)) if n > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy().astype(np.float64), side="right").astype(np.int32))

    first = {r.b: r.low for r in keyed.select("ord", bucket("ord").alias("b")).groupBy("b").agg(F.min("ord").alias("low")).collect()}
    order = sorted(first)
    tails = [(first[b], order[i - 1]) for i, b in enumerate(order)]  # at most n rows; the first range follows the last
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    known = F.broadcast(spark.createDataFrame(tails, "ord long, bucket int"))
    own = keyed.select(bucket("ord").alias("bucket"), F.lit(0).alias("tail"), "ord", "h", "doc_id", "text")
    next_ = keyed.join(known, "ord").select("bucket", F.lit(1).alias("tail"), "ord", "h", "doc_id", "text")
    return own.union(next_).repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "ord", "h")


def edited_likeness(documents: DataFrame, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepare(documents.sparkSession)
    docs = texts_of(documents)
    known = np.unique(_hashes(list(anchors)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(rows: list[tuple], after: list[str]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
        sets = spot_sets(pa.array([*texts, after[-1]], pa.string()), known, chain)
        changed = spot_sets(pa.array(edited, pa.string()), known, chain)
        follow = [sets[i + 1] if after[i] is texts[i + 1] else None for i in range(len(rows) - 1)] + [sets[-1]]
        follow = [f if f is not None else spot_sets(pa.array([n], pa.string()), known, chain)[0] for f, n in zip(follow, after)]
        return pa.record_batch([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([as_text(s) for s in sets[:-1]], pa.string()), pa.array([as_text(s) for s in changed], pa.string()),
            pa.array([likeness(s, t) for s, t in zip(sets, changed)], pa.float64()),
            pa.array([likeness(s, t) for s, t in zip(sets, follow)], pa.float64())], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, after, size = None, [], [], 0  # the document waiting for its next one; finished pairs
        for b in batches:
            for bucket, tail, doc, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))):
                if held is not None and held[0] == bucket:
                    rows.append(held[1:])
                    after.append(text)
                    size += len(held[2])
                    if len(rows) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                        yield results(rows, after)
                        rows, after, size = [], [], 0
                held = (bucket, doc, text) if not tail else None
        if rows:
            yield results(rows, after)
    return _in_ranges(docs).select("bucket", "tail", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
