"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised to lower-case (A-Z) runs of letters, digits and non-ASCII
characters joined by one blank.  Every window of ``window`` consecutive words of
an item (an item of fewer words is one window) is a pattern between blanks, so a
match starts and ends at words.  Each document is scanned once; a match is turned
into word numbers and, for documents with matches, into offsets of the original text.

The automaton holds at most ``BLOCK_CHARS`` characters of benchmark text.  A larger
benchmark is cut into such blocks of items, scanned block by block, and the hits of
a document are united, so nothing unbounded is sent to the tasks.

Defined results: null text has no words; an item without words or with a null
item_id is left out; a repeated item_id counts once; a document with a null or
repeated doc_id gives one row per input row; an empty benchmark hits nothing;
extra columns are ignored.
"""
from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import carried, prepare, restored, staged, texts_of

#: Characters of benchmark text in one automaton (its nodes take some 30 times as many bytes of memory).
BLOCK_CHARS = 1 << 20

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SCHEMA = "doc_id long, key long, n_words long, hits array<struct<word:int,start:int,end:int>>, items array<string>"
_HIT = pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def build_automaton(items: list[tuple[str, str]], window: int) -> ahocorasick.Automaton:
    """Automaton over all windows; a pattern's value is (number of words, its item ids)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text.encode())
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            pattern = (b" " + b" ".join(words[i: i + n]) + b" ").decode("latin-1")
            found.setdefault(pattern, (n, set()))[1].add(item)
    auto = ahocorasick.Automaton()
    for pattern, value in found.items():
        auto.add_word(pattern, value)
    if found:
        auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, text: str) -> tuple[int, list[tuple[int, int, int]], list[str]]:
    """(number of words, [(word number, start, end in the original text)] of hit words, item ids found)."""
    words = normal_words(text.encode())
    if not words or not len(auto):
        return len(words), [], []
    hit, items, ends = None, set(), None
    for at, (n, ids) in auto.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        if hit is None:
            hit = np.zeros(len(words), bool)
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, at))
        hit[last - n + 1: last + 1] = True
        items |= ids
    if hit is None:
        return len(words), [], []
    spans = [(i, m.start(), m.end()) for i, m in enumerate(_WORD.finditer(text)) if hit[i]]
    return len(words), spans, sorted(items)


def _scanned(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = build_automaton(known.value, window)
        for b in batches:
            got = [scan(auto, t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([
                b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()),
                pa.array([[dict(zip(("word", "start", "end"), h)) for h in g[1]] for g in got], _HIT),
                pa.array([g[2] for g in got], pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "hits", "items"])
    return docs.select("doc_id", "key", "text").mapInArrow(run, _SCHEMA)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of at most ``BLOCK_CHARS`` characters (or one item), one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")) \
        .where("i is not null and t is not null")
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    yield block


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, hits (word number and original offsets of every hit word), items (ids found)."""
    prepare(documents.sparkSession)
    docs = texts_of(documents)
    blocks = item_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # the usual case: all of the benchmark in one automaton, one scan, no shuffle
        return _scanned(docs.withColumn("key", F.lit(0).cast("long")), first, window).drop("key")
    docs = docs.withColumn("key", F.xxhash64("text"))
    return _united(docs, [_scanned(docs, b, window) for b in itertools.chain([first, second], blocks)])


def _united(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Hits of several blocks, united per document (rows of one doc_id and text have equal hits)."""
    found = None
    for p in parts:
        hits = staged(p.where("size(items) > 0").dropDuplicates(["doc_id", "key"]), "hits")
        found = hits if found is None else found.union(hits)
    found = found.groupBy("doc_id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    base = parts[0].select("doc_id", "key", "n_words").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key"))
    none = parts[0].schema
    return base.join(found.alias("f"), same, "left").select(
        "d.doc_id", "d.n_words", F.coalesce("f.hits", F.array().cast(none["hits"].dataType)).alias("hits"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, all columns kept.

    The scan runs on whole rows, so nothing is joined back: the text is scanned where it lies.
    """
    prepare(documents.sparkSession)
    kept = carried(documents)
    for block in item_blocks(benchmark):
        kept = _filtered(kept, block, window)
    return restored(kept, documents.columns)


def _filtered(rows: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = build_automaton(known.value, window)
        for b in batches:
            keep = [not scan(auto, t or "")[2] for t in b.column(1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
    return rows.mapInArrow(run, rows.schema)
