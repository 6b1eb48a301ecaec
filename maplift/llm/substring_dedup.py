"""Substring dedup by De Bruijn compaction of token k-mers.

A window is ``window`` consecutive words of one document; a word goes when a window that
covers it also starts in a document with a smaller doc_id (judged on the input).

1. Edges.  k-mers of ``window // 2 + 1`` words are the edges of a token De Bruijn graph.  Of all
   k-mers those are taken that are the smallest (by hash) of some window, so every window holds
   one, equal windows hold the same ones, and about one word in ``window / 4`` starts one.  Two
   consecutive edges of a document overlap, so (edge, distance, edge) fixes all words between.
2. Repeated edges are those that occur in several documents.  An edge is joined to its successor when
   it has only that one, at one distance, in all its occurrences, and is its only predecessor.
   Such nonbranching paths are compacted by pointer jumping, in Spark joins.
3. Every occurrence of a path reads the same words, so a path's smallest document holds all its
   windows: words inside an occurrence of a path elsewhere are repeated (if it spans a window).
4. Windows that hold a repeated edge but do not lie within one path are verified at their
   source coordinates: by a 128-bit hash of their words and the smallest document with it.

Defined results: null or empty text has no words; a document with a null doc_id is kept whole and is
nobody's source; rows of one doc_id are no source for one another, whether their texts are equal
or not; passages repeated only within a document stay; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import by_slot, in_filter, only_ids, opened, prepare, slices, slot_filter, staged, text_bytes, texts_of
from maplift.llm.wordhash import U, Words, join_hash, mix, ngrams, words_of

_KEYS = ["doc_id", "tid"]


def sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every run of n values (op: np.minimum or np.maximum), by doubling."""
    size = 1
    while size * 2 <= n:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (n - size)], x[n - size:]) if n > size else x


def edges_of(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word number, hash) of the sampled k-mers of a slice of texts."""
    k, n = window // 2 + 1, len(w.hash)
    per = window - k + 1  # k-mers in a window
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, np.zeros(0, np.uint64)
    kmer = ngrams(w.hash, k)
    low = sliding(kmer, per, np.minimum)
    size = np.diff(w.first)
    doc = np.repeat(np.arange(len(size)), size)
    inside = doc[: len(low)] == doc[window - 1: window - 1 + len(low)]
    low[~inside] = 0
    pad = np.zeros(per - 1, np.uint64)
    top = sliding(np.concatenate([pad, low, pad]), per, np.maximum)  # best window that holds each k-mer
    at = np.flatnonzero((kmer == top) & (top > 0))
    return doc[at], at - w.first[doc[at]], kmer[at]


def _link(edge: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return join_hash(edge, gap.astype(np.uint64) + U(1))


def _edge_rows(docs: DataFrame, window: int, wanted=None) -> DataFrame:
    """(edge) of all sampled k-mers, or with ``wanted`` the occurrences of those in the slot filter."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else opened(wanted)
        for batch in batches:
            for b in slices(batch):
                w = words_of(*text_bytes(b.column(2)), kind="space", lower=False)
                doc, at, edge = edges_of(w, window)
                if bits is None:
                    yield pa.record_batch([pa.array(edge.view(np.int64))], names=["edge"])
                    continue
                same = doc[1:] == doc[:-1]
                gap = np.where(same, np.diff(at), 0)
                after, before = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
                after[:-1][same] = edge[1:][same]
                before[1:][same] = edge[:-1][same]
                gap_after, gap_before = np.append(gap, 0)[: len(edge)], np.append(0, gap)[: len(edge)]
                keep = in_filter(bits, edge)
                d = pa.array(doc[keep])
                yield pa.record_batch([
                    b.column(0).take(d), b.column(1).take(d), pa.array(at[keep].astype(np.int32)),
                    *(pa.array(x[keep].view(np.int64)) for x in (edge, after, _link(after, gap_after), _link(before, gap_before))),
                    pa.array(gap_after[keep].astype(np.int32))],
                    names=["doc_id", "tid", "at", "edge", "after", "next", "prev", "gap"])
    return docs.mapInArrow(run, "edge long" if wanted is None else
                           "doc_id long, tid long, at int, edge long, after long, next long, prev long, gap int")


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, path, offset): path of each edge (its first edge) and its distance from there, by pointer jumping.

    edges: edge, after, gap, one_next, one_prev (whether successor and predecessor are unique).
    """
    firm = edges.where("one_next and after <> 0").select("edge", F.col("after").alias("b"), "gap")
    into = edges.where("one_prev").select(F.col("edge").alias("b"))
    step = firm.join(into, "b").select(F.col("b").alias("edge"), F.col("edge").alias("path"), F.col("gap").cast("long").alias("offset"))
    now = staged(edges.select("edge").join(step, "edge", "left").select(
        "edge", F.coalesce("path", "edge").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset")), "paths")
    while True:  # pointers reach twice as far in each round; a path's first edge points to itself
        jump = now.select(F.col("edge").alias("path"), F.col("path").alias("p2"), F.col("offset").alias("o2"))
        now = staged(now.join(jump, "path").select("edge", F.col("p2").alias("path"), (F.col("offset") + F.col("o2")).alias("offset"),
                                                   (F.col("path") != F.col("p2")).alias("moved")), "paths")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tid, start, stop, low): occurrences of compacted paths; low: smallest doc_id with the path."""
    spark = docs.sparkSession
    k = window // 2 + 1
    twice = _edge_rows(docs, window).groupBy("edge").count().where("count > 1").select("edge")
    wanted = spark.sparkContext.broadcast(slot_filter(twice, "edge"))
    found = staged(_edge_rows(docs, window, wanted), "edges")
    edges = staged(found.groupBy("edge").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("after").alias("after"), F.min("gap").alias("gap"),
        (F.min("next") == F.max("next")).alias("one_next"), (F.min("prev") == F.max("prev")).alias("one_prev"))
        .where("low < high"), "repeated")
    paths = compacted(edges).join(edges.select("edge", "low"), "edge")
    return staged(found.select(*_KEYS, "at", "edge").join(paths, "edge")
                  .groupBy(*_KEYS, "path", (F.col("at") - F.col("offset")).alias("base"))
                  .agg(F.min("at").alias("start"), (F.max("at") + k).alias("stop"), F.min("low").alias("low"))
                  .select(*_KEYS, "start", F.col("stop").cast("int").alias("stop"), "low"), "spans")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, tid, at): windows that hold a repeated edge and do not lie within one path; docs: with ``spans``."""
    k = window // 2 + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for b in slices(batch):
                done += b.num_rows
                w = words_of(*text_bytes(b.column(2)), kind="space", lower=False)
                open_ = np.zeros(len(w.hash) + 1, np.int64)
                inner = np.zeros(len(w.hash) + 1, np.int64)
                size = np.diff(w.first)
                for i, spans in enumerate(b.column(3).to_pylist()):
                    last, base = int(size[i]) - window, int(w.first[i])
                    if last < 0:
                        continue
                    for s in spans:
                        lo, hi = max(s["start"] + k - window, 0), min(s["stop"] - k, last)
                        if hi >= lo:
                            open_[base + lo] += 1
                            open_[base + hi + 1] -= 1
                        if s["stop"] - s["start"] >= window:
                            inner[base + s["start"]] += 1
                            inner[base + s["stop"] - window + 1] -= 1
                at = np.flatnonzero((np.cumsum(open_) > 0) & (np.cumsum(inner) == 0))
                one, two = ngrams(w.hash, window), ngrams(mix(w.hash ^ U(0x5851F42D4C957F2D)), window)
                doc = np.repeat(np.arange(len(size)), size)[at]
                d = pa.array(doc)
                yield pa.record_batch([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), b.column(0).take(d),
                                       b.column(1).take(d), pa.array((at - w.first[doc]).astype(np.int32))],
                                      names=["h1", "h2", "doc_id", "tid", "at"])
    return docs.select("doc_id", "tid", "text", "spans").mapInArrow(run, "h1 long, h2 long, doc_id long, tid long, at int")


def repeated_words(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tid, gone): per document the word ranges (start, stop) to remove; docs: doc_id, tid, text."""
    spans = repeated_spans(docs, window)
    lists = spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    near = only_ids(docs, spans).join(lists, _KEYS)
    rows = staged(_window_rows(near, window), "windows")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    later = rows.join(first.drop("high"), ["h1", "h2"]).where("doc_id > low").select(
        *_KEYS, F.col("at").alias("start"), (F.col("at") + window).alias("stop"))
    inner = spans.where((F.col("low") < F.col("doc_id")) & (F.col("stop") - F.col("start") >= window)).select(*_KEYS, "start", "stop")
    return staged(later.union(inner).groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "stop")).alias("gone")), "gone")


def without_repeated_passages(documents: DataFrame, window: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, text (the words that stay, joined by one blank)."""
    prepare(documents.sparkSession)
    docs = texts_of(documents).select("doc_id", F.xxhash64("text").alias("tid"), "text")
    gone = repeated_words(docs.where("doc_id is not null"), window)
    touched, rest = by_slot(docs, gone)
    touched = touched.join(gone, _KEYS, "left")
    rest = rest.withColumn("gone", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return rest.unionByName(touched).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, out = [], []
        for text, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            words = text.encode().split()  # ASCII white space only, as in ``words_of``
            size.append(len(words))
            if gone:
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, [g["start"] for g in gone], 1)
                np.add.at(mark, [g["stop"] for g in gone], -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(mark)[:-1] == 0)]
            out.append(words)
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()),
                               pa.array([n - len(o) for n, o in zip(size, out)], pa.int64()),
                               pa.array([b" ".join(o).decode() for o in out], pa.string())],
                              names=["doc_id", "n_words", "n_removed", "text"])
