"""Best-fit packing with Martello-Toth dominance reduction.

A document's token ids (and the end id) are cut into pieces of at most ``capacity`` ids; only
a longer document is cut, its first piece takes the remainder.  Pieces are then packed into as
few sequences as possible.

What matters to a packing is how many pieces of each length there are, and lengths are at most
``capacity``.  So Spark tokenizes and counts, the plan is made from the ``capacity`` counts, and
Spark gives each piece its place:

1. Dominance.  For a piece j with room r beside it, a small set {j, ...} is fixed if it
   dominates every other set with j, that is, if any other choice could be exchanged for
   it: j alone when nothing fits; j and the largest fitting k when they fill the sequence, when
   no two others fit beside j, or when every fitting pair is no longer than k (and no three fit);
   j and a pair when the pair is piecewise no shorter than every other pair.
   Fixed sets leave the instance, all their repetitions at once.
2. The rest is packed best-fit decreasing, again length by length.
3. Equal contents of sequences form a pattern with a count.  A pattern ends only when the count
   of some length does, so there are few patterns, whatever the input.

The n-th piece of a length belongs to the pattern that covers rank n; ranks are numbered
in salted groups, so a length that a third of all pieces have is numbered by many tasks.

Defined results: null and empty texts are the end id alone; rows with a null or repeated doc_id
are packed like any other; an empty table gives no pieces; extra columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maplift.llm.bytebpe import ByteBpe, byte_bpe
from maplift.llm.common import prepare, staged, texts_of

END_ID, CAPACITY = 2, 1024
#: Pieces of one length that one task numbers, on average.
RANK_GROUP = 100_000


# ------------------------------------------------------------------ tokens
def encoding(file: bytes) -> ByteBpe:
    """Encoder with the vocabulary of a byte-level BPE file of the tokenizers library.

    Ids equal that library's (add_special_tokens=False): added tokens in a text, as ``<|endoftext|>``, have
    the ids of the file."""
    return byte_bpe(file, True)


def token_ids(enc: ByteBpe, text: str) -> np.ndarray:
    return np.append(enc.encode(text), END_ID).astype("<u4")


def cuts(n: int, capacity: int) -> list[int]:
    """Piece boundaries of a document of n ids: only a longer one is cut, the first piece is the shorter."""
    return [0, *range((n - 1) % capacity + 1, n + 1, capacity)]


def _broadcast_file(spark, tokenizer_path: str):
    with open(tokenizer_path, "rb") as f:  # a vocabulary, read by the driver
        return spark.sparkContext.broadcast(zlib.compress(f.read()))


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents."""
    known = _broadcast_file(documents.sparkSession, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(known.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = token_ids(enc, text)
                at = cuts(len(ids), capacity)
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                    part = ids[lo:hi]
                    rows.append((doc, i, lo, hi - lo, zlib.crc32(part.tobytes()), part if with_ids else None))
            cols = list(zip(*rows)) or [[]] * 6
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array(cols[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.record_batch(out, names=names)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return texts_of(documents).mapInArrow(run, schema)


# ------------------------------------------------------------------ the plan
Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), number of sequences


def _at_most(count: np.ndarray, room: int) -> int:
    """Largest length of at most ``room`` that is left, or 0."""
    fit = np.flatnonzero(count[: max(room, 0) + 1])
    return int(fit[-1]) if len(fit) else 0


def _smallest(count: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for s in np.flatnonzero(count)[:n]:
        out += [int(s)] * min(int(count[s]), n - len(out))
    return out[:n]


def _pairs(count: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """For each left length b the largest a >= b that fits with it (longest pairs are enough to compare)."""
    for b in np.flatnonzero(count[: room // 2 + 1]).tolist():
        count[b] -= 1
        a = _at_most(count, room - b)
        count[b] += 1
        if a >= b:
            yield a, b


def dominating_set(count: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths of a set with j that dominates every other feasible set with j, or None."""
    count[j] -= 1
    try:
        room = capacity - j
        k = _at_most(count, room)
        if not k:
            return (j,)
        small = _smallest(count, 3)
        if k == room or len(small) < 2 or small[0] + small[1] > room:
            return j, k
        if len(small) > 2 and sum(small) <= room:
            return None  # three others may fit: sets of more than three are not compared
        pairs = list(_pairs(count, room))
        if all(a + b <= k for a, b in pairs):
            return j, k
        best_b = max(b for _, b in pairs)
        best_a = max(a for a, b in pairs if b == best_b)
        if best_a >= k:  # piecewise no shorter than any other pair, and than k alone
            return j, best_a, best_b
        return None
    finally:
        count[j] += 1


def reduce_by_dominance(count: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """(fixed patterns, counts that remain): sets that dominate all alternatives leave the instance for good."""
    count, fixed, open_lengths = count.copy(), [], True
    while open_lengths:
        open_lengths = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                found = dominating_set(count, j, capacity)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                # what is found depends only on which lengths are left and whether once, twice or more often,
                # so it holds as long as more than three of each remain
                times = max(1, min((int(count[x]) - 3) // n for x, n in need.items()))
                for x, n in need.items():
                    count[x] -= n * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                open_lengths = True
    return fixed, count


def best_fit_decreasing(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Pack counts of lengths: longest first, each into the fullest sequence that has room."""
    open_: dict[tuple[int, tuple], int] = {}  # (room, content) -> number of sequences
    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        while left:
            fits = [key for key in open_ if key[0] >= length]
            room, content = min(fits) if fits else (capacity, ())
            copies = room // length  # the fullest sequence stays the fullest while it has room
            have = open_.pop((room, content), None)
            want = max(left // copies, 1)
            used = want if have is None else min(have, want)
            copies = min(copies, left)
            if have is not None and have > used:
                open_[room, content] = have - used
            key = (room - copies * length, (*content, (length, copies)))
            open_[key] = open_.get(key, 0) + used
            left -= used * copies
    return [(content, n) for (_, content), n in open_.items()]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use exactly the counted lengths (index: length)."""
    fixed, rest = reduce_by_dominance(count, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for content, n in patterns:
        at = 0
        for length, copies in content:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, copies, at))
            rank[length] = first + copies * n
            at += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ------------------------------------------------------------------ packing
def ranked(df: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, numbered in salted groups."""
    groups = max(1, -(-total // RANK_GROUP))
    df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)))
    size = df.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = size.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
                         .alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return (df.withColumn("own", own).join(before, ["length", "salt"])
            .withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "salt"))


def packed(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    prepare(spark)
    rows = staged(pieces(documents, tokenizer_path, capacity), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(places(plan(count, capacity)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            high = int(rank.max(initial=0)) + 1
            base = max(high, int(t[:, 1].max(initial=0)) + 1)
            row = t[np.searchsorted(t[:, 0] * base + t[:, 1], length * base + rank, side="right") - 1]
            u = rank - row[:, 1]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(row[:, 2] + u // row[:, 3]), pa.array(row[:, 4] + u % row[:, 3] * length)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked(rows, int(count.sum())).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(documents: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, its pieces in order."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces(documents, tokenizer_path, capacity, with_ids=True).dropDuplicates(key)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in key]
    both = placed.alias("p").join(ids.alias("i"), same).select("p.sequence_id", "p.offset", "i.ids")
    return both.groupBy("sequence_id").agg(  # at most ``capacity`` ids
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
