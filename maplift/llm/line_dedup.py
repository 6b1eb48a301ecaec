"""Line dedup: exact set-similarity join of all lines, later matches removed.

A line (text between ``\\n``) is the set of its words (runs of anything but ASCII white
space, A-Z lower-cased).  A line goes when an earlier line, by (doc_id, line number),
has a Jaccard similarity of at least num/den with it; this is judged on the input, not on
what is left.  Lines without words are never removed.

How it is computed:

1. Lines with equal word sets form a class (128-bit identity); all but a class's first
   line go.  So only classes are compared.
2. A fixed-size table of word counts over all documents (2**24 slots) gives one order of
   words, rarest first.  Slots may be shared, which changes the order, not the result.
3. Similar sets share a word within their first n - ceil(n * num / den) + 1 words.  Each
   class emits these prefix words with their position; a word whose slot was counted once
   can meet nothing.
4. Pairs are cut by length, by position (the overlap that is still possible) and by parity
   sketches of the sets (each element that only one set has flips one bit, so sets that differ
   in more bits than they may differ in elements are apart): one of 128 bits beside each word,
   one of two bits an element for the pairs that are left.  Each class is first checked against
   a few earlier classes that pass, for each of its words; those that match none and have more
   partners are compared with all of them, in blocks (``linking``).  Words of many classes are dealt
   into blocks before any task reads them, and their classes count as having more partners.

Defined results: null or empty text has one empty line and stays as it is; documents with
a null doc_id are left unchanged and match nothing; rows that repeat a doc_id share line
positions, so the later row's lines are not "later" and stay; extra columns are kept.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from maplift.llm.common import batches_of, by_slot, carried, in_filter, only_ids, opened, prepare, restored, slices, slot_filter, staged, text_bytes, texts_of
from maplift.llm.linking import block_count, block_of, checked, overlaps
from maplift.llm.wordhash import U, Words, mix, words_of

COUNT_BITS, _CHUNK = 24, 1 << 16
#: Counts below COUNT_EXACT are coded as they are; above, a code goes up by COUNT_STEPS for each doubling.
COUNT_EXACT, COUNT_STEPS = 1 << 15, 512
#: Rows and bytes of an Arrow batch of lines, words or pairs, which are far smaller than documents.
LINE_ROWS, LINE_BYTES = 1 << 14, 1 << 20
#: Bytes of a node that hold its first position (``ordered_node``).
POSITION = 12


# ------------------------------------------------------------------ lines of a slice
def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line offsets, document of each line, line number in its document)."""
    cut = np.flatnonzero(buf == 10) + 1
    # every document starts a line, also an empty one
    edges = np.concatenate([off[:-1], cut])
    doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, cut - 1, side="right") - 1])
    order = np.lexsort((edges, doc))
    edges, doc = edges[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    return np.append(edges, off[-1]), doc, np.arange(len(doc)) - first[doc]


def line_sets(w: Words, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, word hash, count) of the distinct words of each line, rarest first within a line."""
    n = np.diff(w.first)
    line = np.repeat(np.arange(len(n)), n)
    h = w.hash
    c = np.zeros(len(h), np.uint64) if counts is None else counts[slot_of(h)].astype(np.uint64)
    if len(n) < 1 << 21:
        key = (line.astype(np.uint64) << U(43)) | (c << U(27)) | (h >> U(37))
        order = np.argsort(key)
        k, g = key[order], h[order]
        if np.any((k[1:] == k[:-1]) & (g[1:] != g[:-1])):
            order = np.lexsort((h, c, line))
    else:
        order = np.lexsort((h, c, line))
    line, h, c = line[order], h[order], c[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return line[fresh], h[fresh], c[fresh]


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - COUNT_BITS)).astype(np.int64)


def line_ids(line: np.ndarray, h: np.ndarray, n_lines: int) -> tuple[np.ndarray, list[bytes | None]]:
    """(number of words, 128-bit identity or None) of each line's word set."""
    size = np.bincount(line, minlength=n_lines)
    out = np.zeros((n_lines, 2), np.uint64)
    if len(h):
        at = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        out[line[at], 0] = np.add.reduceat(mix(h ^ U(0xA24BAED4963EE407)), at)
        out[line[at], 1] = np.add.reduceat(mix(h + U(0x8CB92BA72F3D8DD7)), at)
        out[:, 0] += size.astype(np.uint64)
    raw = out.tobytes()
    return size, [raw[16 * i: 16 * i + 16] if s else None for i, s in enumerate(size.tolist())]


def line_keys(ids: list[bytes | None]) -> np.ndarray:
    """The first 64 bits of each identity, 0 where there is none."""
    return np.frombuffer(b"".join(i[:8] if i else bytes(8) for i in ids), np.int64)


def wide_sketches(line: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, first word of each line): parity sketches of at least two bits an element, a power of two of words."""
    words = 1 << np.ceil(np.log2(np.maximum(size, 32) / 32)).astype(np.int64)
    first = np.append(0, np.cumsum(words))
    bit = (h >> U(20)).astype(np.int64) & (words[line] * 64 - 1)
    out = np.zeros(int(first[-1]), np.uint64)
    np.bitwise_xor.at(out, first[line] + (bit >> 6), U(1) << (bit & 63).astype(np.uint64))
    return out, first


def sketch_distance(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of pairs of wide sketches, the longer ones folded to the length of the shorter."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a]) // 8, np.array([len(x) for x in b]) // 8
    for p, q in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == p) & (lb == q))
        x = np.frombuffer(b"".join([a[i] for i in at]), np.uint64).reshape(len(at), p)
        y = np.frombuffer(b"".join([b[i] for i in at]), np.uint64).reshape(len(at), q)
        while x.shape[1] != y.shape[1]:
            if x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            else:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


# ------------------------------------------------------------------ word counts
def count_codes(n: np.ndarray) -> np.ndarray:
    """16-bit codes in the order of the counts (64 bits); counts up to 2**63 stay below the largest code."""
    high = COUNT_EXACT + COUNT_STEPS * np.log2(np.maximum(n, COUNT_EXACT) / COUNT_EXACT)
    return np.where(n < COUNT_EXACT, n, high).astype(np.uint16)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Counts (``count_codes``) of all words of all documents in 2**COUNT_BITS slots: 32 MB at any scale."""
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for b in slices(batch):
                np.add.at(total, slot_of(words_of(*text_bytes(b.column(1))).hash), np.uint32(1))
        for chunk in range(0, 1 << COUNT_BITS, _CHUNK):
            part = total[chunk: chunk + _CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.record_batch([pa.array([chunk // _CHUNK], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                                       pa.array([part[at].tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, at, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if c not in total:
                    total[c] = np.zeros(_CHUNK, np.int64)
                total[c][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        for c, t in total.items():
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([zlib.compress(count_codes(t).tobytes(), 1)])],
                                  names=["chunk", "n"])

    out = np.zeros(1 << COUNT_BITS, np.uint16)
    parts = docs.mapInArrow(partial, "chunk int, at binary, n binary").repartition("chunk").mapInArrow(summed, "chunk int, n binary")
    for row in parts.collect():  # at most 32 MB
        out[row.chunk * _CHUNK: (row.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(row.n), np.uint16)
    return out


# ------------------------------------------------------------------ the join
def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-n * num // den) + 1


def _line_rows(docs: DataFrame, counts, num: int, den: int) -> DataFrame:
    """Per line with words: doc_id, line, node, h, size, sketch (two halves), wide (sketch), keys (prefix words counted twice or more), places,
    often (those of keys that may lie on more than KEY_ROWS lines)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = opened(counts, np.uint16)
        for batch in batches:
            for b in slices(batch):
                buf, off = text_bytes(b.column(1))
                edges, doc, number = lines_of(buf, off)
                line, h, c = line_sets(words_of(buf, edges), count)
                size, ids = line_ids(line, h, len(doc))
                first = np.searchsorted(line, np.arange(len(doc)))
                place = np.arange(len(line)) - first[line]
                keep = (place < prefix_length(size, num, den)[line]) & (c >= 2)
                full = np.flatnonzero(size > 0)
                one = U(1) << (h & U(63))
                high = (h >> U(6) & U(1)).astype(bool)
                halves = [np.bitwise_xor.reduceat(np.where(high == half, one, U(0)), first[full]) if len(full) else np.zeros(0, np.uint64)
                          for half in (False, True)]
                wide, at = wide_sketches(line, h, size)
                wide = wide.tobytes()
                ends = np.searchsorted(line[keep], np.append(full, len(doc)))
                many = keep & (c > min(KEY_ROWS, COUNT_EXACT - 1))
                many_ends = np.searchsorted(line[many], np.append(full, len(doc)))
                yield pa.record_batch([
                    b.column(0).take(pa.array(doc[full])), pa.array(number[full].astype(np.int32)),
                    pa.array(ids, pa.binary()).take(pa.array(full)), pa.array(line_keys(ids)[full]), pa.array(size[full]),
                    *(pa.array(x.view(np.int64)) for x in halves),
                    pa.array([wide[8 * at[i]: 8 * at[i + 1]] for i in full.tolist()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[keep].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[keep].astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(many_ends.astype(np.int32)), pa.array(h[many].view(np.int64)))],
                    names=["doc_id", "line", "node", "h", "size", "sketch", "sketch2", "wide", "keys", "places", "often"])
    return docs.mapInArrow(run, "doc_id long, line int, node binary, h long, size long, sketch long, sketch2 long, wide binary, "
                                "keys array<long>, places array<int>, often array<long>")


def _verify(num: int, den: int):
    """Pairs (earlier, later) of similar lines; a node is its class identity after its first position."""
    def sets(nodes, texts):
        col = pa.array(texts, pa.string())
        buf, off = text_bytes(col)
        line, h, _ = line_sets(words_of(buf, off))
        at = np.searchsorted(line, np.arange(len(texts) + 1))
        return [np.sort(h[a:b]) for a, b in zip(at[:-1], at[1:])]

    def verify(a: list[bytes], at: list[str], b: list[bytes], bt: list[str]) -> list[tuple[bytes, bytes]]:
        if not a or not b:
            return []
        left, right = sets(a, at), sets(b, bt)
        inter = overlaps(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
        ok = den * inter >= num * union
        later: dict[bytes, bytes] = {}
        for i, j in zip(*np.nonzero(ok)):
            if a[i][:POSITION] < b[j][:POSITION]:
                later.setdefault(b[j], a[i])
            elif b[j][:POSITION] < a[i][:POSITION]:
                later.setdefault(a[i], b[j])
        return [(v, k) for k, v in later.items()]
    return verify


def later_matches(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): all lines with words (doc_id, line, node) and those to remove (doc_id, line, node)."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(zlib.compress(word_counts(docs).tobytes(), 1))
    lines = staged(_line_rows(docs, counts, num, den), "lines")
    with batches_of(spark, LINE_ROWS, LINE_BYTES):
        several = staged(classes_of_several(lines), "classes")
        matched = _matched(docs, lines, several, num, den)
    # only the classes that lose lines are joined: those of several lines and those with an earlier match
    later = staged(several.select("node", "d0", "l0").join(matched, "node", "full"), "later")
    gone = (lines.select("doc_id", "line", "node").join(later, "node")
            .where("matched is not null or doc_id <> d0 or line <> l0").select("doc_id", "line", "node"))
    return lines, gone


def classes_of_several(lines: DataFrame) -> DataFrame:
    """(node, h, d0, l0): classes of more than one line, and their first position.

    A position is one number here, so that Spark aggregates by hashing; a struct has to be sorted."""
    at = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    found = lines.groupBy("node").agg(F.min(at).alias("at"), F.min("h").alias("h"), F.count("*").alias("n")).where("n > 1")
    line = F.expr("pmod(at, 2147483648BD)")
    return found.withColumn("l0", line.cast("int")).select(
        "node", "h", F.expr("(at - pmod(at, 2147483648BD)) div 2147483648BD").cast("long").alias("d0"), "l0")


def _matched(docs: DataFrame, lines: DataFrame, several: DataFrame, num: int, den: int) -> DataFrame:
    """(node, matched): classes with an earlier similar class; several: classes of more than one line, with their first position.

    In what follows a class is named by h, a 64-bit hash of its identity, and its first document; where
    two classes share an h, their texts are told apart when they are compared."""
    verify = _verify(num, den)
    # each class against the earliest one among those of its words that pass the filters
    often = lines.where("size(often) > 0").select("h", F.explode("often").alias("key"))
    hot = staged(hot_keys(often), "hot-keys")
    copied = docs.sparkSession.sparkContext.broadcast(slot_filter(several, "h"))
    copies = staged(_first_lines(lines, several, copied), "copies")
    posts = in_blocks(_posts_of_classes(lines, copied, copies), hot)
    posts = posts.repartition(partner_tasks(lines), "key")
    pairs = staged(_first_partners(posts, num, den).groupBy("center", "node").agg(
        F.min("size1").alias("size1"), F.min("size").alias("size"), F.min("d1").alias("d1"), F.min("d2").alias("d2"),
        F.max("more").alias("more")), "partners")
    cut = often.join(F.broadcast(hot), "key", "left_semi").select("h")
    open_ = pairs.where("more").select(F.col("node").alias("h")).union(cut).distinct()
    pairs = staged(_within_distance(pairs, lines, num, den), "star")
    ids = pairs.select(F.col("center").alias("h"), F.col("d1").alias("doc")).union(pairs.select("node", "d2"))
    texts = staged(_line_texts(docs, ids.distinct()), "line-texts")
    found = _found(_similar_pairs(pairs, texts, num, den), texts, "star-links")

    # those without a match that have further partners: all earlier classes that pass the filters
    left = staged(open_.join(found.select("h").distinct(), "h", "left_anti"), "left")
    if not left.isEmpty():
        def bits(df, col):
            return docs.sparkSession.sparkContext.broadcast(slot_filter(df, col))
        own = _posts_of_classes(lines, copied, copies, by_h=bits(left, "h")).join(left, "h", "left_semi").select(*_POST)
        own = staged(own, "left-posts")
        blocks = staged(own.groupBy("key").agg(key_blocks().alias("m")), "left-keys")
        others = (_posts_of_classes(lines, copied, copies, by_key=bits(own, "key")).join(blocks, "key")
                  .select(*_POST, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("y")))
        earlier = ((F.col("a.key") == F.col("b.key")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.h") != F.col("b.h"))
                   & (F.col("a.doc") <= F.col("b.doc")) & may_match(num, den))
        asked = own.join(blocks, "key").withColumn("y", block_of("h", "m"))
        rest = others.alias("a").join(asked.alias("b"), earlier, "left_semi").select(*_POST)
        rest = staged(rest.dropDuplicates(["key", "h"]), "earlier")
        todo = own.join(rest.select("key").distinct(), "key", "left_semi")
        ids = own.select("h", "doc").union(rest.select("h", "doc"))
        found = found.union(_checked(_open_rows(rest, todo), docs, ids, verify, "block-links"))
    return found.select("node").distinct().withColumn("matched", F.lit(1))


_POST = ["key", "h", "doc", "size", "place", "sketch", "sketch2"]


_LINE = ["h", "doc_id", "size", "sketch", "sketch2", "keys", "places"]


def _first_lines(lines: DataFrame, several: DataFrame, copied) -> DataFrame:
    """The first line of each class that may have several (its h is in the slot filter ``copied``)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = opened(copied)
        for b in batches:
            yield b.filter(pa.array(in_filter(slots, b.column(0).to_numpy())))
    rows = lines.where("size(keys) > 0").select(*_LINE, "node", "line")
    rows = rows.mapInArrow(run, rows.schema).join(several.select("node", "d0", "l0"), "node", "left")
    # a class that is not there has one line; rows that repeat a doc_id may hold a first line twice
    return rows.where("d0 is null or (doc_id = d0 and line = l0)").dropDuplicates(["node"]).select(*_LINE)


def _posts_of_classes(lines: DataFrame, copied, copies: DataFrame, by_h=None, by_key=None) -> DataFrame:
    """(key, h, doc, size, place, sketches): the prefix words of each class, once; doc: its first document.

    Lines whose h is in the slot filter ``copied`` are taken from ``copies`` (``_first_lines``).
    ``by_h`` and ``by_key`` are slot filters that leave out most of what is not asked for."""
    rows = lines.where("size(keys) > 0")
    posts = _postings(rows, copied, by_h, by_key).union(_postings(copies, None, by_h, by_key))
    return posts.withColumnRenamed("doc_id", "doc").select(*_POST)


#: Classes of a word up to which they lie in one task; words with more are dealt into blocks of about so many.
KEY_ROWS = 1 << 15


def key_blocks():
    """Number of blocks of a word, from the number of its rows."""
    return F.ceil(F.count("*") / F.lit(KEY_ROWS)).cast("long")


def hot_keys(often: DataFrame) -> DataFrame:
    """(key, n): words with more than KEY_ROWS classes and their number of blocks; at most one for KEY_ROWS postings."""
    return (often.distinct().groupBy("key").agg(F.count("*").alias("rows"), key_blocks().alias("n"))
            .where(F.col("rows") > KEY_ROWS).select("key", "n"))


def in_blocks(posts: DataFrame, hot: DataFrame) -> DataFrame:
    """The postings, with a key of its own for each block of a hot word."""
    block = F.xxhash64("key", block_of("h", "n"))
    return (posts.join(F.broadcast(hot), "key", "left")
            .withColumn("key", F.when(F.col("n").isNull(), F.col("key")).otherwise(block)).select(*_POST))


#: Rows of whole keys that a task holds, as an average, and the distance (in rows) up to which they are compared.
PARTNER_ROWS, PARTNER_REACH = 1 << 18, 4_096
#: Partners of a class and word that are checked at once; classes with more that match none of them go to the second step.
PARTNERS = 8


def partner_tasks(lines: DataFrame) -> int:
    """Number of tasks for the prefix words of all lines, so that each holds about PARTNER_ROWS of them."""
    rows = lines.agg(F.sum(F.size("keys"))).first()[0] or 0
    return max(lines.sparkSession.sparkContext.defaultParallelism, -(-rows // PARTNER_ROWS))


def _first_partners(posts: DataFrame, num: int, den: int) -> DataFrame:
    """(center, node, size1, size, d1, d2, more): for each class and word earlier classes that pass the
    filters, up to PARTNERS of them, and whether there are more.  Classes of one document are
    partners of each other: which line comes first is seen when they are compared.

    A key's rows come in the order of their sizes, and each row is compared with the rows before it until
    their sizes differ too much, a whole batch at once.  In keys with rows that have more than PARTNER_REACH
    rows before them, all rows are left to the second step (more).  A key is a word or a block of a hot one
    (``in_blocks``); ``posts`` are dealt by key, to as many tasks as give each about PARTNER_ROWS rows."""
    def passing(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n1, n2, p1, p2 = x["size"][i], x["size"][j], x["place"][i], x["place"][j]
        ok = (np.minimum(n1 - p1, n2 - p2) + np.minimum(p1, p2)) * (num + den) >= (n1 + n2) * num
        differ = sum(np.bitwise_count((x[c][i[ok]] ^ x[c][j[ok]]).view(np.uint64)).astype(np.int64) for c in ("sketch", "sketch2"))
        ok[ok] = differ * (num + den) <= (n1 + n2)[ok] * (den - num)
        return ok & (x["h"][i] != x["h"][j])

    def compared(x: dict) -> pa.RecordBatch:
        n, doc, h, size = len(x["key"]), x["doc"], x["h"], x["size"]
        start = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        rank = np.arange(n) - start[group]
        seen, some = np.zeros(n, np.int64), []

        def note(later: np.ndarray, earlier: np.ndarray) -> None:
            first = seen[later] < PARTNERS
            some.append((later[first], earlier[first]))
            seen[later] += 1
        live, back = np.flatnonzero(rank >= 1), 1
        while len(live) and back <= PARTNER_REACH:
            live = live[size[live - back] * den >= size[live] * num]
            i = live[passing(x, live, live - back)]
            j = i - back
            after, before = doc[i] >= doc[j], doc[i] <= doc[j]  # within a document either line may be the later one
            note(i[after], j[after])
            note(j[before], i[before])
            back += 1
            live = live[rank[live] >= back]
        far = np.zeros(n, bool)
        if len(live):  # give every row of such a key a partner, so that the second step hears of it
            far = np.isin(group, group[live])
            lone = np.flatnonzero(far & (seen == 0))
            some.append((lone, np.where(rank[lone] > 0, start[group[lone]], np.minimum(lone + 1, n - 1))))
        later = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in some)])
        earlier = np.concatenate([np.zeros(0, np.int64), *(b for _, b in some)])
        return pa.record_batch([pa.array(h[earlier]), pa.array(h[later]), pa.array(size[earlier]), pa.array(size[later]),
                                pa.array(doc[earlier]), pa.array(doc[later]), pa.array((seen[later] > PARTNERS) | far[later])],
                               names=["center", "node", "size1", "size", "d1", "d2", "more"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held)
            x = {c: t.column(c).to_numpy() for c in _POST}
            order = np.lexsort((x["size"], x["key"]))
            yield compared({c: v[order] for c, v in x.items()})
    return posts.mapInArrow(run, "center long, node long, size1 long, size long, d1 long, d2 long, more boolean")


def _checked(rows: DataFrame, docs: DataFrame, ids: DataFrame, verify, name: str) -> DataFrame:
    """(node): classes found to have an earlier match among groups of h; ids: h and its first document."""
    texts = staged(_line_texts(docs, ids.distinct()), "line-texts")
    rows = rows.withColumnRenamed("node", "h")
    later = checked(rows, lambda r: r.join(texts, "h"), verify, name)
    return _found(later.select(F.col("b").alias("node")), texts, name)


def _found(later: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(node, h) of classes given by their first position and identity."""
    return staged(later.distinct().join(texts.select("node", "h"), "node")
                  .select(F.substring("node", 13, 16).alias("node"), "h").distinct(), name)


def _within_distance(pairs: DataFrame, lines: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose wide sketches do not differ in more bits than the sets may in elements."""
    asked = pairs.select(F.col("center").alias("h")).union(pairs.select("node")).distinct()
    bits = lines.sparkSession.sparkContext.broadcast(slot_filter(asked, "h"))

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = opened(bits)
        for b in batches:
            yield b.filter(pa.array(in_filter(slots, b.column(0).to_numpy())))
    wide = lines.select("h", F.col("wide").alias("w")).mapInArrow(known, "h long, w binary").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy() + b.column(3).to_numpy()
            apart = sketch_distance(b.column(6).to_pylist(), b.column(7).to_pylist())
            keep = pa.array(apart * (num + den) <= size * (den - num))
            yield b.select([0, 1, 2, 3, 4, 5]).filter(keep)
    both = (pairs.join(wide.select(F.col("h").alias("center"), F.col("w").alias("w1")), "center")
            .join(wide.select(F.col("h").alias("node"), F.col("w").alias("w2")), "node"))
    return both.select("center", "node", "size1", "size", "d1", "d2", "w1", "w2").mapInArrow(
        run, "center long, node long, size1 long, size long, d1 long, d2 long")


def _similar_pairs(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """(node): the later class of each pair (center, node) that is similar; a batch of pairs is compared at once."""
    a = texts.select(F.col("h").alias("center"), F.col("node").alias("n1"), F.col("text").alias("t1"))
    b = texts.select(F.col("h").alias("node"), F.col("node").alias("n2"), F.col("text").alias("t2"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [line_sets(words_of(*text_bytes(batch.column(i)))) for i in (1, 3)]
            pair = np.concatenate([sides[0][0], sides[1][0]])
            word = np.concatenate([sides[0][1], sides[1][1]])
            order = np.lexsort((word, pair))
            pair, word = pair[order], word[order]
            shared = pair[1:][(pair[1:] == pair[:-1]) & (word[1:] == word[:-1])]
            n = batch.num_rows
            inter, total = np.bincount(shared, minlength=n), np.bincount(pair, minlength=n)
            ok = den * inter >= num * (total - inter)
            later = [max(x, y) for x, y, good in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ok)
                     if good and x[:POSITION] != y[:POSITION]]
            yield pa.record_batch([pa.array(later, pa.binary())], names=["node"])
    return (pairs.select("center", "node").join(a, "center").join(b, "node").select("n1", "t1", "n2", "t2")
            .mapInArrow(run, "node binary"))


def _postings(lines: DataFrame, but=None, by_h=None, by_key=None) -> DataFrame:
    """(h, doc_id, size, sketches, key, place): prefix words of the lines whose h is not in the slot filter ``but``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else opened(x) for x in (but, by_h, by_key)]
        for b in batches:
            keys, places, h = b.column(5), b.column(6), b.column(0).to_numpy()
            key = keys.flatten().to_numpy()
            line = np.ones(len(h), bool) if but is None else ~in_filter(filters[0], h)
            if by_h is not None:
                line &= in_filter(filters[1], h)
            keep = np.repeat(line, np.diff(keys.offsets.to_numpy()))
            if by_key is not None:
                keep &= in_filter(filters[2], key)
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(keys.offsets.to_numpy()))[keep])
            yield pa.record_batch([*(b.column(i).take(row) for i in range(5)), pa.array(key[keep]),
                                   pa.array(places.flatten().to_numpy()[keep])],
                                  names=["h", "doc_id", "size", "sketch", "sketch2", "key", "place"])
    return lines.select(*_LINE).mapInArrow(
        run, "h long, doc_id long, size long, sketch long, sketch2 long, key long, place int")


def ordered_node(doc_id: str, line: str, node: str):
    """12 bytes that order like (doc_id, line), then the class identity."""
    sign = F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat(F.unhex(F.lpad(F.hex(sign), 16, "0")), F.unhex(F.lpad(F.hex(F.col(line)), 8, "0")), F.col(node))


def may_match(num: int, den: int):
    """Length, positional and sketch filter of two sets a and b that share a word."""
    n1, p1, n2, p2 = (F.col(c) for c in ("a.size", "a.place", "b.size", "b.place"))
    differ = (F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
              + F.bit_count(F.col("a.sketch2").bitwiseXOR(F.col("b.sketch2"))))
    return ((F.least(n1, n2) * den >= F.greatest(n1, n2) * num)
            & ((F.least(n1 - p1, n2 - p2) + F.least(p1, p2)) * (num + den) >= (n1 + n2) * num)
            & (differ * (num + den) <= (n1 + n2) * (den - num)))


def _line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, node, text) of classes, from their first documents; node: first position, then identity."""
    asked = ids.select("h", F.col("doc").alias("doc_id"))
    bits = docs.sparkSession.sparkContext.broadcast(slot_filter(asked, "h"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(bits)
        for batch in batches:
            for b in slices(batch):
                buf, off = text_bytes(b.column(1))
                edges, doc, number = lines_of(buf, off)
                line, h, _ = line_sets(words_of(buf, edges))
                size, ids = line_ids(line, h, len(doc))
                name = line_keys(ids)
                full = np.flatnonzero((size > 0) & in_filter(known, name))
                raw = buf.tobytes()
                yield pa.record_batch([
                    b.column(0).take(pa.array(doc[full])), pa.array(number[full].astype(np.int32)),
                    pa.array(ids, pa.binary()).take(pa.array(full)), pa.array(name[full]),
                    pa.array([raw[edges[i]: edges[i + 1]].decode() for i in full], pa.string())],
                    names=["doc_id", "line", "cls", "h", "text"])
    found = only_ids(docs, asked).mapInArrow(run, "doc_id long, line int, cls binary, h long, text string")
    found = found.join(asked, ["h", "doc_id"], "left_semi")
    return found.groupBy("h", "cls").agg(F.min(F.struct("doc_id", "line", "text")).alias("t")).select(
        "h", ordered_node("t.doc_id", "t.line", "cls").alias("node"), F.col("t.text").alias("text"))


def _open_rows(rest: DataFrame, todo: DataFrame) -> DataFrame:
    """Groups of blocks: unsettled classes (role 1) against all classes of their word (role 0)."""
    rest, todo = (df.withColumnRenamed("h", "node") for df in (rest, todo))
    n = rest.groupBy("key").agg(block_count().alias("n")).join(
        todo.groupBy("key").agg(block_count().alias("m")), "key")
    a = rest.join(n, "key").withColumn("x", block_of("node", "n")).select(
        "key", "node", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("y"), F.lit(0).alias("role"))
    b = todo.join(n, "key").withColumn("y", block_of("node", "m")).select(
        "key", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"), "y", F.lit(1).alias("role"))
    return a.unionByName(b).select(F.xxhash64("key", "x", "y").alias("gid"), "role", "node")


# ------------------------------------------------------------------ documents
def without_similar_lines(documents: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with later matches removed from ``text``; adds n_lines and n_removed."""
    prepare(documents.sparkSession)
    docs = texts_of(documents).where("doc_id is not null")
    _, gone = later_matches(docs, num, den)
    lists = gone.groupBy("doc_id").agg(F.collect_set(F.struct("line", "node")).alias("_gone"))
    lists = staged(lists, "gone")
    touched, rest = by_slot(carried(documents), lists)
    touched = touched.join(lists, "doc_id", "left")
    rest = rest.withColumn("_gone", F.lit(None).cast("array<struct<line:int,node:binary>>"))
    return restored(rewritten(rest.unionByName(touched)), documents.columns, "n_lines", "n_removed")


def rewritten(df: DataFrame) -> DataFrame:
    """Drop the lines listed in ``_gone`` (number and class; another row's list does not apply) from ``text``."""
    df = df.select("rest", "text", "_gone")
    schema = StructType([*df.select("rest", "text").schema.fields, StructField("n_lines", LongType()),
                         StructField("n_removed", LongType())])

    def cut(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        """(texts, removed lines) of rows with a list each or none."""
        buf, off = text_bytes(b.column(1).fill_null(""))
        edges, doc, _ = lines_of(buf, off)
        first = np.searchsorted(doc, np.arange(b.num_rows + 1))
        listed = b.column(2)
        owner = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(listed), 0).to_numpy())
        entry = listed.flatten()
        at = first[owner] + entry.field("line").to_numpy()
        known = at < first[owner + 1]  # a list of another row with this doc_id may name lines that are not here
        asked, node = at[known], entry.field("node").filter(pa.array(known)).to_pylist()
        each = np.unique(asked)
        raw = buf.tobytes()
        parts = [raw[edges[i]: edges[i + 1]] for i in each.tolist()]
        ends = np.append(0, np.cumsum([len(x) for x in parts])).astype(np.int64)
        line, h, _ = line_sets(words_of(np.frombuffer(b"".join(parts), np.uint8), ends))
        ids = line_ids(line, h, len(each))[1]
        gone = np.zeros(len(doc), bool)
        gone[[i for i, k, n in zip(asked.tolist(), np.searchsorted(each, asked).tolist(), node) if ids[k] == n]] = True
        removed = np.bincount(doc[gone], minlength=b.num_rows)
        texts = b.column(1).to_pylist()
        for i in np.flatnonzero(removed).tolist():
            texts[i] = "\n".join(x for x, g in zip(texts[i].split("\n"), gone[first[i]: first[i + 1]].tolist()) if not g)
        return pa.array(texts, pa.string()), removed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                n_lines = pc.add(pc.fill_null(pc.count_substring(b.column(1), "\n"), 0).cast(pa.int64()), 1)
                text, removed = b.column(1), np.zeros(b.num_rows, np.int64)
                if b.column(2).null_count < b.num_rows:
                    text, removed = cut(b)
                yield pa.record_batch([b.column(0), text, n_lines, pa.array(removed.astype(np.int64))],
                                      names=["rest", "text", "n_lines", "n_removed"])
    return df.mapInArrow(run, schema)
