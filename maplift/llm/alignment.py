"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE, B a piece model with byte fallback; B adds a space before a text, so A
encodes space+text.  Byte offsets where tokens of both end ("shared ends") cut a document into groups;
every A token of a group is linked with every B token of it.

1. A text is tokenised whole by both.  Token lengths give the ends of both sides; the shared ones are
   verified on the bytes (a text whose tokens do not spell it has none).
2. Shared ends before a token that starts with a space are anchors.  They cut the document into
   windows of token ids, mostly one word each.  Equal windows have equal alignments, so a window
   is aligned once per worker and found again by its id tuples (A's ids, then B's ids).
3. An id pair's count is the number of documents that hold it linked.  Tasks count their documents' pairs
   before anything is shuffled; a document's pairs are kept beside it in compressed form, so texts
   are tokenised once.
4. Scores need the counts again.  The most frequent pairs (at most ``HEAD`` of them, cut by a histogram of
   the counts) are sent to all tasks; the rest, which no more documents hold than the last of those,
   is joined by pair.  So no pair is hot in the join, and what is sent has a bound.

Defined results: null and empty texts, and texts whose joined token bytes differ from space+text (as texts with
U+2581), have no tokens: zeros and an empty digest.  Rows with a null or repeated doc_id are documents of
their own.  An empty table gives no rows; extra columns are ignored.  Very long texts are read whole; memory
grows with a document's tokens and, in a group without shared ends, with its distinct pairs.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.bytebpe import byte_bpe
from maplift.llm.common import prepare, slices, staged, texts_of

#: Id pairs whose counts are sent to every task (17 bytes each); the others are joined.
HEAD = 1 << 20
#: Windows a worker remembers before it starts anew, and pairs a task counts before it hands them on.
MEMO, PAIRS = 1 << 17, 1 << 21
#: Bytes of text aligned at a time: few enough that the working arrays stay in the processor's cache.
SLICE_BYTES = 1 << 18
SPACE_MARK = "▁"


# ------------------------------------------------------------------ tokens
class PieceModel:
    """A sentencepiece model and the bytes of its pieces."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.token_bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])  # <0xHH>
        return piece.replace(SPACE_MARK, " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


class Side:
    """The bytes of one tokenizer's tokens, their lengths, and which start with a space."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.size = np.array([len(t) for t in token_bytes], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in token_bytes], bool)
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


# ------------------------------------------------------------------ windows
#: What is known of a window: its groups as text, and its links as 64-bit integers: pair code, how many, pair code, ...
Aligned = tuple[str, bytes]


#: Links of a group up to which each is written out; in larger groups each distinct pair is written once.
SMALL_GROUP = 64


class Aligner:
    """Aligns the documents of one task."""

    def __init__(self, a, b):
        self.enc_a, self.enc_b = a, b
        self.a, self.b = Side(a.token_bytes), Side(b.token_bytes)
        self.n_b = len(b.token_bytes)
        self.n_ids = max(len(a.token_bytes), self.n_b)
        self.marked = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.n_ids)], object)
        self.memo: dict[bytes, Aligned] = {}

    def windows(self, keys: list[bytes]) -> list[Aligned]:
        """The alignments of windows by their id tuples; those seen for the first time are aligned together."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        known = list(map(self.memo.get, keys))
        new = [i for i, w in enumerate(known) if w is None]
        if new:
            made = self.align_windows([keys[i] for i in new])
            for i, w in zip(new, made):
                known[i] = self.memo[keys[i]] = w
        return known

    def align_windows(self, keys: list[bytes]) -> list[Aligned]:
        flat = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
        size = np.array([len(k) for k in keys], np.int64) // 4
        start = np.cumsum(size) - size
        n_a = flat[start]
        place = np.arange(len(flat)) - np.repeat(start, size)
        of_a = place <= np.repeat(n_a, size)
        a, b = flat[of_a & (place > 0)], flat[~of_a]
        # both sides of a window cover the same bytes, so ends can be compared over all windows at once
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at_b = np.searchsorted(ends_b, ends_a)
        ia = np.flatnonzero(ends_b[at_b] == ends_a)
        hi_a, hi_b = ia + 1, at_b[ia] + 1
        g_a, g_b = np.diff(hi_a, prepend=0), np.diff(hi_b, prepend=0)
        lo_a, lo_b = hi_a - g_a, hi_b - g_b
        # texts: each group's A ids, then its B ids, every id with the mark that follows it
        ids = np.empty(len(a) + len(b), np.int64)
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[ia], after_b[hi_b - 1] = 1, 2
        ids[np.arange(len(a)) + np.repeat(lo_b, g_a)] = a + after_a * self.n_ids
        ids[np.arange(len(b)) + np.repeat(hi_a, g_b)] = b + after_b * self.n_ids
        said = self.marked[ids].tolist()
        # links: every pair of a small group, each distinct pair of a large one
        n = g_a * g_b
        small = np.where(n <= SMALL_GROUP, n, 0)
        g = np.repeat(np.arange(len(n)), small)
        k = np.arange(len(g)) - np.repeat(np.cumsum(small) - small, small)
        links = np.ones((len(g), 2), np.int64)
        links[:, 0] = a[lo_a[g] + k // g_b[g]] * self.n_b + b[lo_b[g] + k % g_b[g]]
        window_of_group = np.searchsorted(np.cumsum(n_a), ia, side="right")
        upto = np.searchsorted(window_of_group[g], np.arange(len(keys) + 1))
        more: dict[int, bytes] = {}
        for big in np.flatnonzero(n > SMALL_GROUP).tolist():
            (ua, ca), (ub, cb) = (np.unique(x, return_counts=True) for x in (a[lo_a[big]: hi_a[big]], b[lo_b[big]: hi_b[big]]))
            both = np.stack([(ua[:, None] * self.n_b + ub).ravel(), (ca[:, None] * cb).ravel()], axis=1)
            w = int(window_of_group[big])
            more[w] = more.get(w, b"") + both.tobytes()
        raw = links.tobytes()
        text_at, link_at = np.append(0, np.cumsum(size - 1)).tolist(), (upto * 16).tolist()
        return [("".join(said[text_at[w]: text_at[w + 1]])[:-1], raw[link_at[w]: link_at[w + 1]] + more.get(w, b""))
                for w in range(len(keys))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both sides' ids of each text, or None where a side's tokens do not spell space+text."""
        got: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if t:
                a, b = self.enc_a.encode(" " + t), self.enc_b.encode(t)
                if self.a.size[a].sum() == self.b.size[b].sum() == len(t.encode()) + 1:
                    got[i] = a, b
        docs = [i for i, g in enumerate(got) if g is not None]
        if docs:
            said = np.frombuffer(b"".join([b" " + texts[i].encode() for i in docs]), np.uint8)
            end = np.cumsum([len(texts[i].encode()) + 1 for i in docs])
            for side, k in ((self.a, 0), (self.b, 1)):
                for at in np.flatnonzero(side.spelled(np.concatenate([got[i][k] for i in docs])) != said).tolist():
                    got[docs[int(np.searchsorted(end, at, side="right"))]] = None
        return got

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, n_pairs, codes, times) of each text; see ``packed_pairs``."""
        got = self.tokens(texts)
        out: list[tuple] = [(0, 0, 0, 0, "", 0, None, None)] * len(texts)
        docs = [i for i, g in enumerate(got) if g is not None]
        if not docs:
            return out
        size_a, size_b = (np.array([len(got[i][s]) for i in docs], np.int64) for s in (0, 1))
        a, b = (np.concatenate([got[i][s] for i in docs]) for s in (0, 1))
        doc_a = np.repeat(np.arange(len(docs)), size_a)
        # ends over all documents at once: both sides spell the same bytes, so documents end at shared ends
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        at_b = np.searchsorted(ends_b, ends_a)
        ia = np.flatnonzero(ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends_a)
        ib = at_b[ia]
        # anchors: the next token of A starts with a space, and so, from the same byte on, does that of B;
        # each document starts with a space, so its predecessor ends with an anchor
        anchor = np.append(self.a.spaced[a[ia[:-1] + 1]] & self.b.spaced[b[ib[:-1] + 1]], True)
        hi_a, hi_b = ia[anchor] + 1, ib[anchor] + 1
        doc = doc_a[hi_a - 1]
        seen, which = self._distinct(a, b, hi_a, hi_b)
        known = self.windows(seen)
        first = np.searchsorted(doc, np.arange(len(docs) + 1))
        pair_doc, code, times = self._pairs(doc, which, known)
        cut = np.searchsorted(pair_doc, np.arange(len(docs) + 1))
        groups = np.bincount(doc_a[ia], minlength=len(docs))
        text_of = [k[0] for k in known]
        for d, i in enumerate(docs):
            said = ";".join([text_of[w] for w in which[first[d]: first[d + 1]].tolist()])
            c, t = code[cut[d]: cut[d + 1]], times[cut[d]: cut[d + 1]]
            out[i] = (int(size_a[d]), int(size_b[d]), int(groups[d]), int(t.sum()), hashlib.sha256(said.encode()).hexdigest(),
                      len(c), *packed_pairs(c, t))
        return out

    @staticmethod
    def _distinct(a, b, hi_a, hi_b) -> tuple[list[bytes], np.ndarray]:
        """The distinct windows as bytes (A's length, A's ids, B's ids) and the number of each window in that list."""
        n_a, n_b = np.diff(hi_a, prepend=0), np.diff(hi_b, prepend=0)
        size = 1 + n_a + n_b
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), "<u4")
        flat[start] = n_a
        flat[np.repeat(start + 1 - (hi_a - n_a), n_a) + np.arange(len(a))] = a
        flat[np.repeat(start + 1 + n_a - (hi_b - n_b), n_b) + np.arange(len(b))] = b
        offsets = np.append(start, len(flat)) * 4  # of bytes
        keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size),
                                                [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
        coded = keys.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy()

    def _pairs(self, doc, which, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, code, links) of the distinct pairs of each document, ordered."""
        uses, used = np.unique(doc * len(known) + which, return_counts=True)
        doc, which = np.divmod(uses, len(known))
        size = np.array([len(k[1]) for k in known], np.int64) // 16
        start = np.cumsum(size) - size
        codes, times = np.frombuffer(b"".join([k[1] for k in known]), np.int64).reshape(-1, 2).T
        n = size[which]
        at = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        span = len(self.a.token_bytes) * self.n_b
        keys, back = np.unique(np.repeat(doc, n) * span + codes[at], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.repeat(used, n) * times[at])
        return *np.divmod(keys, span), total


# ------------------------------------------------------------------ a document's pairs, compressed
def packed_pairs(codes: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending codes as steps, and their links, each in the narrowest integers that hold them."""
    def narrow(x: np.ndarray) -> bytes:
        return zlib.compress(x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes(), 1)
    return narrow(np.diff(codes, prepend=0)), narrow(times)


def opened_pairs(n: list[int], steps: list[bytes | None], times: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, links) of the pairs of several documents."""
    def wide(raw: bytes, k: int) -> np.ndarray:
        data = zlib.decompress(raw)
        return np.frombuffer(data, f"<u{len(data) // k}").astype(np.int64)
    full = [(r, k, s, t) for r, (k, s, t) in enumerate(zip(n, steps, times)) if k]
    if not full:
        none = np.zeros(0, np.int64)
        return none, none, none
    return (np.repeat([f[0] for f in full], [f[1] for f in full]), np.concatenate([np.cumsum(wide(s, k)) for _, k, s, _ in full]),
            np.concatenate([wide(t, k) for _, k, _, t in full]))


# ------------------------------------------------------------------ Spark
_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, "
            "steps binary, times binary")


def _file(spark, path: str):
    with open(path, "rb") as f:  # a vocabulary, read by the driver
        return spark.sparkContext.broadcast(zlib.compress(f.read()))


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: token, group and link counts, the digest of its groups, and its pairs (compressed)."""
    spark = documents.sparkSession
    file_a, file_b = _file(spark, path_a), _file(spark, path_b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Aligner(byte_bpe(file_a.value, False), PieceModel(zlib.decompress(file_b.value)))
        for batch in batches:
            for b in slices(batch, limit=SLICE_BYTES):
                rows = worker.align(b.column(1).to_pylist())
                cols = list(zip(*rows))
                types = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                      names=[f.split()[0] for f in _ALIGNED.split(", ")])
    return texts_of(documents).mapInArrow(run, _ALIGNED)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ones, n = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate(held), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, back, np.concatenate(ones))
        return codes, total
    for b in batches:
        code, count = np.unique(opened_pairs(*(b.column(i).to_pylist() for i in range(3)))[1], return_counts=True)
        held.append(code)
        ones.append(count)
        n += len(code)
        if n > PAIRS:
            codes, total = summed()
            held, ones, n = [codes], [total], len(codes)
            if n > PAIRS // 2:  # repeats no longer shrink it: hand on what is counted
                yield pa.record_batch([pa.array(codes), pa.array(total)], names=["code", "n"])
                held, ones, n = [], [], 0
    if held:
        codes, total = summed()
        yield pa.record_batch([pa.array(codes), pa.array(total)], names=["code", "n"])


def pair_counts(docs: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best) of every linked pair: documents that hold it, and whether its A id has no more frequent one."""
    n = (docs.where("n_pairs > 0").select("n_pairs", "steps", "times").mapInArrow(_counted, "code long, n long")
         .groupBy("code").agg(F.sum("n").alias("n")))
    n = staged(n.withColumn("a", F.expr(f"code div {n_b}")), "pair-counts")
    top = n.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of A
    return n.join(top, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _size_class(col: str = "n"):
    return F.floor(F.log2(col) * 8).cast("int")


def _head_class(counts: DataFrame) -> tuple[int, bool]:
    """Lowest size class from which on at most HEAD pairs have their counts, and whether there are pairs below it."""
    sizes = sorted(counts.groupBy(_size_class().alias("c")).count().collect(), reverse=True)  # a few hundred rows
    low, total = (sizes[0]["c"] + 1 if sizes else 0), 0
    for r in sizes:
        total += r["count"]
        if total > HEAD:
            return low, True
        low = r["c"]
    return low, False


def pair_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` (with ``row``) and, over a document's links, n_best and count_sum."""
    spark = docs.sparkSession
    low, more = _head_class(counts)
    head = counts.where(_size_class() >= low).toArrow().combine_chunks()  # at most HEAD rows
    order = np.argsort(head["code"].to_numpy())
    known = spark.sparkContext.broadcast(tuple(head[c].to_numpy()[order] for c in ("code", "n", "best")))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = known.value
        for b in batches:
            row, code, times = opened_pairs(*(b.column(c).to_pylist() for c in ("n_pairs", "steps", "times")))
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            score, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(score, row[hit], times[hit] * n[at[hit]])
            np.add.at(top, row[hit], times[hit] * best[at[hit]])
            rest = np.searchsorted(row[~hit], np.arange(b.num_rows + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(code[~hit]), pa.array(times[~hit])], names=["code", "links"])
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(top), pa.array(score), pa.ListArray.from_arrays(rest, pairs)],
                                  names=[*kept, "n_best", "count_sum", "rest"])
    out = docs.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                               "n_best long, count_sum long, rest array<struct<code: long, links: long>>")
    if not more:
        return out.drop("rest")
    rare = counts.where(_size_class() < low)
    pairs = out.select("row", F.explode("rest").alias("p")).select("row", "p.code", "p.links")
    more = pairs.join(rare, "code").groupBy("row").agg(
        F.sum(F.col("links") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("b"))
    both = out.drop("rest").join(more, "row", "left")
    return both.select(*kept, *((F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c) for c, x in (("n_best", "b"), ("count_sum", "s"))))


def cross_tokenizer_alignment(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    prepare(documents.sparkSession)
    docs = staged(aligned(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = staged(pair_counts(docs, n_b), "pairs")
    return pair_scores(docs, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
