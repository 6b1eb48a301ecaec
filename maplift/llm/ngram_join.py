"""N-gram Jaccard join by PartEnum signatures.

Each text is the set of its distinct n-word shingles.  Sizes are cut into
bands; two sets whose Jaccard similarity reaches num/den lie in the same
band or in neighbouring ones, and differ in at most

    k = floor(2 * r * (den - num) / (den + num))

elements, r being the largest size of the band.  For every band a set takes
part in, the shingle domain is partitioned by hash and subsets of partitions
are enumerated: a set's signature is the hash of its elements in one subset.
Differences spoil at most k partitions, so similar sets agree on some subset.

More partitions than k + 1 are made, and a set leaves out as many of its
poorest subsets as that surplus allows: a subset on which two sets agree holds
the same elements in both, so both leave it out or neither, and at least one
agreed subset stays.  Empty subsets, which would put unrelated sets together,
are thereby left out.

Signatures that occur once are dropped before anything else is moved; sets
that share one are verified exactly (``linking``).  Copies collapse to one
class (a 128-bit identity of the set) before that.  A signature of few elements
is also shared by sets that have little else in common: parity sketches
(``sketch``) rule those out, and only the texts of the others are moved.

Defined results: a null or blank text has an empty set and is linked with
nothing; a document with a null doc_id keeps its n_shingles, is linked with
nothing, and has a null component_id; a repeated doc_id gives one row per
input row, and its rows share the smallest doc_id over the classes they
belong to only through links; extra input columns are ignored; an empty table
gives an empty result.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import by_slot, carried, in_filter, only_ids, opened, prepare, restored, slices, slot_filter, staged, text_bytes, texts_of
from maplift.llm.linking import Near, forest, linked_groups, overlaps, texts_by_doc
from maplift.llm.sketch import sketch
from maplift.llm.wordhash import U, join_hash, mix, set_id, shingle_sets, words_of

#: Bands grow by (den / num) ** BAND_POWER.
BAND_POWER = 2
#: Partitions made for each one that is needed, when sets are large.
SURPLUS = 1.5
#: Up to this many differences subsets of two partitions are enumerated, beyond it single partitions.
SMALL_K = 3


@lru_cache(maxsize=None)
def band(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(index, smallest, largest size) of the band of a set size."""
    i, lo = 0, 1
    while True:
        hi = max(lo, int(lo * (den / num) ** BAND_POWER))
        if size <= hi:
            return i, lo, hi
        i, lo = i + 1, hi + 1


def bands_of(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(index, largest size) of the bands in which a set of this size gives signatures."""
    i, _, hi = band(size, num, den)
    out = [(i, hi)]
    if size * den >= num * (hi + 1):
        out.append((i + 1, band(hi + 1, num, den)[2]))
    return out


@lru_cache(maxsize=None)
def scheme(k: int) -> tuple[int, np.ndarray, int]:
    """(partitions, subsets of them, how many subsets a set may leave out) for k differences."""
    if k == 0:
        return 1, np.array([[0]]), 0
    if k <= SMALL_K:
        p = k + 3
        return p, np.array(list(itertools.combinations(range(p), 2))), 2  # three clean partitions: three clean pairs
    p = int(np.ceil(SURPLUS * (k + 1)))
    return p, np.arange(p)[:, None], p - k - 1


def signatures(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures (64-bit) of a set of hashes."""
    out = []
    for index, largest in bands_of(len(u), num, den) if len(u) else []:
        k = 2 * largest * (den - num) // (den + num)
        p, subsets, spare = scheme(k)
        seed = U((index + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        m = mix(u ^ seed)
        part = (m % U(p)).astype(np.int64)
        count = np.bincount(part, minlength=p)
        total = np.zeros(p, np.uint64)
        np.add.at(total, part, mix(m))
        size = count[subsets].sum(axis=1)
        value = total[subsets].sum(axis=1, dtype=np.uint64)
        keep = np.ones(len(size), bool)
        if spare:
            keep = size >= np.partition(size, spare)[spare]
        which = np.flatnonzero(keep).astype(np.uint64)
        out.append(join_hash(value[keep] + seed, which + U(k << 32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node): size and 128-bit identity of each text's shingle set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = shingle_sets(words_of(*text_bytes(b.column(1))), words)
                yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())],
                                      names=["doc_id", "n_shingles", "node"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, node binary")


def _signature_rows(docs: DataFrame, words: int, num: int, den: int, wanted=None) -> DataFrame:
    """(key[, node, size, rep]): signatures of all texts; with ``wanted``, those in that slot filter."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else opened(wanted)
        for batch in batches:
            for b in slices(batch):
                sets = shingle_sets(words_of(*text_bytes(b.column(1))), words)
                sigs = [signatures(s, num, den) for s in sets]
                if bits is None:
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64))], names=["key"])
                    continue
                sigs = [s[in_filter(bits, s)] for s in sigs]
                n = [len(s) for s in sigs]
                ids = [set_id(s) if c else b"" for s, c in zip(sets, n)]
                at = np.repeat(np.arange(len(n)), n)
                yield pa.record_batch([
                    pa.array(np.concatenate(sigs).view(np.int64)), pa.array(ids, pa.binary()).take(pa.array(at)),
                    pa.array(np.array([len(s) for s in sets], np.int64)[at]), b.column(0).take(pa.array(at))],
                    names=["key", "node", "size", "rep"])
    return docs.mapInArrow(run, "key long" if wanted is None else "key long, node binary, size long, rep long")


def _sketches(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(node, sketch) of the shingle sets of reps (node, doc_id)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = [s for s in shingle_sets(words_of(*text_bytes(b.column(1))), words) if len(s)]
                yield pa.record_batch([pa.array([set_id(s) for s in sets], pa.binary()),
                                       pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "sketch"])
    found = only_ids(docs, reps).mapInArrow(run, "node binary, sketch binary")
    return staged(found.join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sketches")


def similar_sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, label): groups of linked shingle sets; sets without a link to another set are absent."""
    spark = docs.sparkSession
    shared = _signature_rows(docs, words, num, den).groupBy("key").count().where("count > 1").select("key")
    wanted = spark.sparkContext.broadcast(slot_filter(shared, "key"))
    members = staged(_signature_rows(docs, words, num, den, wanted)
                     .groupBy("key", "node", "size").agg(F.min("rep").alias("rep")), "signatures")

    def verify(a: list[bytes], at: list[str], b: list[bytes], bt: list[str]) -> list[tuple[bytes, bytes]]:
        def sets(nodes, texts):
            got = {}
            col = pa.array(texts, pa.string())
            for n, s in zip(nodes, shingle_sets(words_of(*text_bytes(col)), words)):
                if set_id(s) == n:  # a repeated doc_id may bring another text
                    got.setdefault(n, s)
            return list(got), list(got.values())
        an, as_ = sets(a, at)
        bn, bs = (an, as_) if a is b else sets(b, bt)
        inter = overlaps(as_, bs)
        union = np.array([len(s) for s in as_])[:, None] + np.array([len(s) for s in bs])[None, :] - inter
        i, j = np.nonzero(den * inter >= num * union) if len(an) and len(bn) else ((), ())
        return forest((an[x], bn[y]) for x, y in zip(i, j) if an[x] != bn[y])

    reps = members.groupBy("node").agg(F.min("rep").alias("doc_id"))
    near = Near(lambda nodes: _sketches(docs, reps.join(nodes, "node"), words), num, den)
    return linked_groups(members.drop("rep"), texts_by_doc(docs, reps), verify, num / den * (1 - 1e-9), near)


def ngram_jaccard_join(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when den * |intersection| >= num * |union| of their sets of ``words``-word shingles.
    """
    prepare(documents.sparkSession)
    docs = texts_of(documents)
    own = docs.where("doc_id is not null")
    sets = staged(text_sets(docs, words), "sets")
    labels = similar_sets(own, words, num, den)
    classes = (sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
               .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    least = staged(classes.join(least, "label").select("node", "component_id"), "classes")
    return (sets.join(least, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def without_near_duplicates(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of linked ones (the smallest doc_id), all columns kept.

    Of rows that repeat a doc_id with the same text one stays; rows with a null doc_id stay.  Only documents
    that may go are moved.
    """
    found = staged(ngram_jaccard_join(documents, words, num, den), "groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = staged(gone.withColumn("gone", F.lit(True)).join(again.withColumn("again", F.lit(True)), "doc_id", "full"), "gone")
    touched, rest = by_slot(carried(documents), gone)
    touched = touched.join(gone, "doc_id", "left").where("gone is null")
    once = touched.where("again").dropDuplicates(["doc_id", "text"])
    kept = touched.where("again is null").union(once).select("rest", "text")
    return restored(rest.select("rest", "text").union(kept), documents.columns)
