"""From rows (key, node) to groups of linked nodes, without emitting all pairs of a key.

Nodes that share a key *may* be linked; ``verify`` decides.  The work is
done in two steps, both exact together:

1. star: every node of a key is checked against the key's smallest node;
2. blocks: keys whose other nodes still carry different group labels are
   cut into blocks of bounded size, and pairs of blocks are checked inside
   tasks, which emit found links only.

So a key with n similar nodes costs n rows, and only keys that hold
dissimilar nodes reach the second step.  Blocks bound what a task holds,
whatever the size of a key.

Where ``Near`` is given, sketches of the nodes (``sketch``) come before their
texts in both steps: only the texts of pairs, and of nodes of a key, whose
sketches do not rule a link out are moved.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import only_ids, staged
from maplift.llm.sketch import any_near, pairs_near

#: Summed set sizes of a block, and its number of nodes, as averages.
BLOCK_SIZE, BLOCK_NODES = 1 << 18, 512
#: Blocks of sketches hold so many times as much as blocks of texts.
SKETCH_BLOCKS = 8

#: (nodes, texts) of the two sides of a group -> pairs of linked nodes; equal sides are one and the same list
Verify = Callable[[list[bytes], list[str], list[bytes], list[str]], list[tuple[bytes, bytes]]]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``edges`` (a, b).

    Alternates large-star and small-star steps until the edges stay the same;
    each step is a partial aggregation and a join, written to the shared folder.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .where("a <> b").distinct(), "cc")
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = staged(small.select("x.a", "x.b").where("a <> b").distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    lab = e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return staged(lab.union(lab.select(F.col("label").alias("node"), "label").distinct()).distinct(), "labels")


#: adds ``text`` to rows with ``node``
Texts = Callable[[DataFrame], DataFrame]


@dataclass
class Near:
    """``sketches`` gives (node, sketch) of rows with node; links have a Jaccard similarity of num / den at least."""
    sketches: Callable[[DataFrame], DataFrame]
    num: int
    den: int


def block_count(times: int = 1) -> Column:
    """Number of blocks of a group, from the summed sizes and the number of its nodes."""
    return F.ceil(F.greatest(F.sum("size") / F.lit(BLOCK_SIZE * times), F.count("*") / F.lit(BLOCK_NODES * times))).cast("long")


def block_of(node: str, n: str) -> Column:
    return F.pmod(F.xxhash64(F.col(node), F.lit(17)), F.col(n))


def texts_by_doc(docs: DataFrame, reps: DataFrame) -> Texts:
    """Texts of nodes from the documents that hold them; reps: node, doc_id.  Only documents asked for are moved."""
    def with_text(rows: DataFrame) -> DataFrame:
        rows = rows.join(reps, "node")
        return only_ids(docs, rows).join(rows, "doc_id")
    return with_text


def checked(rows: DataFrame, texts: Texts, verify: Verify, name: str) -> DataFrame:
    """Links (a, b) found among groups ``gid``; rows: gid, role, node; ``texts`` adds each node's text.

    role 0 rows are compared with role 1 rows; role 2 rows with one another.
    """
    placed = (texts(rows).repartition("gid").sortWithinPartitions("gid")
              .select("gid", "role", "node", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))
        for _, group in groupby(stream(), key=lambda r: r[0]):
            sides: tuple[set, set, set] = (set(), set(), set())
            for _, role, node, text in group:
                sides[role].add((node, text))
            left = sorted(sides[2] or sides[0])
            right = left if sides[2] else sorted(sides[1])
            a, at = [n for n, _ in left], [t for _, t in left]
            found = verify(a, at, a, at) if sides[2] else verify(a, at, [n for n, _ in right], [t for _, t in right])
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found], pa.binary()),
                                       pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    return staged(placed.mapInArrow(run, "a binary, b binary"), name)


def group_blocks(pairs: DataFrame) -> DataFrame:
    """Rows for ``checked`` from pairs (center, node, size): a center's nodes in blocks, the center with each."""
    n = pairs.groupBy("center").agg(block_count().alias("n"))
    pairs = pairs.join(n, "center").withColumn("gid", F.xxhash64("center", block_of("node", "n")))
    return (pairs.select("gid", F.lit(1).alias("role"), "node")
            .union(pairs.select("gid", F.lit(0).alias("role"), F.col("center").alias("node")).distinct()))


def tails_of(members: DataFrame) -> DataFrame:
    """(key, center, csize, node, size): the nodes of each key beside its smallest one; keys of one node vanish."""
    low = members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("low"))
    return staged(members.join(low, "key").where("node <> low.node").select(
        "key", F.col("low.node").alias("center"), F.col("low.size").alias("csize"), "node", "size"), "tails")


def star_links(tails: DataFrame, texts: Texts, verify: Verify, ratio: float, near: Near | None = None,
               sketches: DataFrame | None = None) -> DataFrame:
    """Links between each key's smallest node and the others; ``ratio``: sizes further apart cannot be linked."""
    close = F.least("size", "csize") >= F.greatest("size", "csize") * F.lit(ratio)
    pairs = tails.where(close).groupBy("center", "node").agg(F.min("csize").alias("csize"), F.min("size").alias("size"))
    pairs = staged(pairs if near is None else near_pairs(pairs, sketches, near), "star")
    return checked(group_blocks(pairs.select("center", "node", "size")), texts, verify, "star-links")


def near_pairs(pairs: DataFrame, sketches: DataFrame, near: Near) -> DataFrame:
    """Those of the pairs (center, node, csize, size) whose sketches do not rule a link out."""
    num, den = near.num, near.den

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            center, node, csize, size, c, s = b.columns
            keep = pairs_near(c.to_pylist(), csize.to_numpy(), s.to_pylist(), size.to_numpy(), num, den)
            yield b.select([0, 1, 2, 3]).filter(pa.array(keep))

    both = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("center"), F.col("sketch").alias("csketch")), "center")
    return both.select(*pairs.columns, "csketch", "sketch").mapInArrow(run, pairs.schema)


def near_nodes(rows: DataFrame, sketches: DataFrame, near: Near) -> DataFrame:
    """Those of the rows (g, node, size, label) whose sketch does not rule out a link with a node of their g and another label."""
    placed = _within(rows, SKETCH_BLOCKS).join(sketches, "node").repartition("gid").sortWithinPartitions("gid")
    num, den = near.num, near.den

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def side(found):
            label = {x: i for i, x in enumerate(sorted({r[5] for r in group}))}
            return ([r[6] for r in found], np.array([r[4] for r in found], np.int64), np.array([label[r[5]] for r in found]))
        for _, group in groupby(stream(), key=lambda r: r[0]):
            group = list(group)
            within = [r for r in group if r[1] == 2]
            a = within or [r for r in group if r[1] == 0]
            b = within or [r for r in group if r[1] == 1]
            if not a or not b:
                continue
            i, j = any_near(*side(a), *side(b), num, den)
            kept = {r[2:5] for r, k in zip(a + b, [*i, *j]) if k}
            if kept:
                g, node, size = zip(*kept)
                yield pa.record_batch([pa.array(g, pa.int64()), pa.array(node, pa.binary()), pa.array(size, pa.int64())],
                                      names=["g", "node", "size"])

    return (placed.select("gid", "role", "g", "node", "size", "label", "sketch")
            .mapInArrow(run, "g long, node binary, size long").distinct())


def block_links(tails: DataFrame, labels: DataFrame, texts: Texts, verify: Verify, near: Near | None = None,
                sketches: DataFrame | None = None) -> DataFrame | None:
    """Links among the nodes of keys that still hold several groups beside their smallest node."""
    rest = tails.select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = (rest.groupBy("key")
                 .agg(F.min("label").alias("x"), F.max("label").alias("y"),
                      F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"), F.count("*").alias("c"))
                 .where("x <> y").groupBy("content", "c").agg(F.min("key").alias("key")))
    if near is None:
        rest = tails.select("key", "node", "size")
    rest = rest.join(open_keys.select("key"), "key", "left_semi")
    if near is not None:
        rest = near_nodes(rest.withColumnRenamed("key", "g"), sketches, near).withColumnRenamed("g", "key")
    rest = staged(rest, "open")
    if rest.isEmpty():
        return None
    return checked(_within(_grouped(rest)), texts, verify, "block-links")


def forest(pairs: Iterable[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Of the links found in a task those that connect groups not yet connected: fewer than nodes."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x
    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _grouped(rows: DataFrame) -> DataFrame:
    """(g, node, size): the groups whose nodes are compared with one another.

    Many keys hold nearly the same nodes, so keys that share nodes are taken together
    as one group where that moves fewer rows than taking each key by itself.
    """
    low = rows.groupBy("key").agg(F.min("node").alias("a"))
    joint = components(rows.join(low, "key").select("a", F.col("node").alias("b")))
    rows = rows.join(joint, "node")
    alone = (rows.groupBy("label", "key").agg((F.count("*") * block_count()).alias("cost"))
             .groupBy("label").agg(F.sum("cost").alias("alone")))
    cost = (rows.select("label", "node", "size").distinct()
            .groupBy("label").agg((F.count("*") * block_count()).alias("together")).join(alone, "label"))
    return (rows.join(cost, "label")
            .select(F.when(F.col("together") <= F.col("alone"), F.xxhash64("label")).otherwise(F.xxhash64("key")).alias("g"),
                    "node", "size").distinct())


def _within(rows: DataFrame, times: int = 1) -> DataFrame:
    """Rows for ``checked`` that compare the nodes of each group g with one another, by pairs of blocks."""
    n = rows.groupBy("g").agg(block_count(times).alias("n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    spread = rows.join(n, "g").withColumn("block", block_of("node", "n")).select("*", other)
    return spread.select(F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("gid"),
                         F.when(F.col("block") == F.col("other"), 2)
                         .when(F.col("block") < F.col("other"), 0).otherwise(1).alias("role"), *rows.columns)


def linked_groups(members: DataFrame, texts: Texts, verify: Verify, ratio: float, near: Near | None = None) -> DataFrame:
    """(node, label) of all nodes that have a link; others are absent. members: key, node, size."""
    tails = tails_of(members)
    sketches = near and near.sketches(tails.select("node").union(tails.select("center")).distinct())
    labels = components(star_links(tails, texts, verify, ratio, near, sketches))
    more = block_links(tails, labels, texts, verify, near, sketches)
    if more is None or more.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))


# ------------------------------------------------------------------ set overlap
def overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of all left sets (sorted distinct hashes) with all right sets."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    vocab = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def placed(sets):
        at, who = [], []
        for i, s in enumerate(sets):
            j = np.searchsorted(vocab, s)
            j = j[(j < len(vocab))]
            j = j[np.isin(vocab[j], s, assume_unique=False)] if len(j) else j
            at.append(j)
            who.append(np.full(len(j), i))
        return np.concatenate(at), np.concatenate(who)

    la, lw = placed(left)
    ra, rw = placed(right)
    for lo in range(0, len(vocab), chunk):
        a = np.zeros((len(left), chunk), np.float32)
        b = np.zeros((len(right), chunk), np.float32)
        m = (la >= lo) & (la < lo + chunk)
        a[lw[m], la[m] - lo] = 1
        m = (ra >= lo) & (ra < lo + chunk)
        b[rw[m], ra[m] - lo] = 1
        out += (a @ b.T).astype(np.int64)
    return out
