"""Exact top-k search by inner product of integer vectors, with a KD-tree per shard.

Components x become floor(1024 x).  Queries are the rows whose vec_id a number divides; candidates are all other rows.

1. Rows get a number and, by its hash, a shard, so that shards are even whatever the vectors are: about as many shards
   as the cluster has tasks, and more where they would hold over ``SHARD_ROWS`` vectors.
2. Each query searches its own shard.  Its kth score there is a lower bound of its kth score over all.
3. It then visits the other shards with that bound.  A task reads one shard's vectors, builds the tree and answers
   queries a batch at a time: best first, by the largest inner product that a box allows (``kdtree``).
   Only candidates that beat the propagated kth leave a shard.
4. The k best of each query over the shards are its result; Spark cuts to k before and after the shuffle.

A query is sent to each shard: that is the stated query set against all rows, whose pairs exist only inside the
tasks, a batch against a leaf.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; a shorter vector counts
as ended by zeros; a row with a null vec_id is no query, and as a candidate comes last among ties (with the greatest long);
rows with the same vec_id are queries and candidates of their own; components are held within +-1e300 and scores within
a long; an empty table, or one without queries, gives no rows; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maplift.llm.common import prepare, staged
from maplift.llm.kdtree import HIGHEST, LOWEST, KdTree
from maplift.llm.vectors import finite_vectors, padded

SCALE, K = 1024, 10
#: Vectors of a shard on average, at most and, while there are fewer shards than tasks, at least.
SHARD_ROWS, LEAST_ROWS = 1 << 16, 1 << 10
#: Shards up to which each gets a partition of its own.
MOST_DEALT = 1 << 12
_FOUND = "query long, query_id long, vec_id long, score long"


def _searched(k: int):
    """Tasks: shard by shard, first its vectors (kind 0), then its queries (kind 1) in batches."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            where, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if where[lo] != shard:
                    shard, held, tree = where[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if tree is None and held:
                    tree, held = _tree(held), []
                if tree is not None:
                    yield _answers(tree, part, k)
    return run


def _ids(col: pa.Array) -> np.ndarray:
    return col.fill_null(HIGHEST).to_numpy()


def _tree(parts: list[pa.RecordBatch]) -> KdTree:
    width = max(int(p.column("vec").value_lengths().to_numpy().max(initial=0)) for p in parts)
    return KdTree(np.vstack([padded(p.column("vec"), width) for p in parts]),
                  np.concatenate([_ids(p.column("vec_id")) for p in parts]), np.concatenate([p.column("row").to_numpy() for p in parts]))


def _answers(tree: KdTree, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    q, width = padded(part.column("vec")), tree.vectors.shape[1]
    q = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))[:, :width]  # beyond the tree's width its vectors are zero
    row, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
    score, rival = part.column("kth").fill_null(LOWEST).to_numpy(), part.column("kth_id").fill_null(HIGHEST).to_numpy()
    best, who = tree.search(q, row, k, score, rival)
    beats = (best > score[:, None]) | ((best == score[:, None]) & (who < rival[:, None]) & (best > LOWEST))
    at, _ = np.nonzero(beats)
    return pa.record_batch([pa.array(row[at]), pa.array(ids[at]), pa.array(who[beats]), pa.array(best[beats])],
                           names=["query", "query_id", "vec_id", "score"])


def _deal(spark, shards: int):
    """A column that hash partitioning into ``shards`` partitions deals one shard each: a number per partition that lands there."""
    if shards > MOST_DEALT:  # so many that chance evens them out
        return F.col("shard")
    found: dict[int, int] = {}
    for r in spark.range(0, shards * 32, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("p")).collect():
        found.setdefault(r.p, r.id)
    numbers = [found.get(p, p) for p in range(shards)]
    return F.expr(f"element_at(array({', '.join(f'{n}L' for n in numbers)}), shard + 1)")


def _visits(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    cols = ["shard", "kind", "row", "vec_id", "vec", "kth", "kth_id"]
    none = F.lit(None).cast("long")
    points = rows.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "vec", none.alias("kth"), none.alias("kth_id"))
    both = points.unionByName(queries.withColumn("kind", F.lit(1)).select(*cols))
    return (both.withColumn("deal", _deal(rows.sparkSession, shards)).repartition(shards, "deal")
            .sortWithinPartitions("shard", "kind").mapInArrow(_searched(k), _FOUND))


def floored(vectors: DataFrame) -> DataFrame:
    """floor(SCALE * x), kept as doubles: a power of two times a double is exact, and so is its whole part."""
    edge = F.lit(1e300)
    scaled = F.transform("vec", lambda x: F.greatest(-edge, F.least(edge, x * F.lit(float(SCALE)))))
    # not F.floor, which gives a long and fails beyond it
    return vectors.withColumn("vec", F.transform(scaled, lambda x: F.rint(x) - (F.rint(x) > x).cast("double")))


def exact_top_k(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of greatest score of each query, ties to smaller vec_id."""
    spark = table.sparkSession
    prepare(spark)
    vectors = floored(finite_vectors(table, id_col, vec_col))
    numbered = staged(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = numbered.count()
    shards = max(1, -(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    rows = numbered.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0)
    none = F.lit(None).cast("long")
    home = staged(_visits(rows, queries.select("*", none.alias("kth"), none.alias("kth_id")), shards, k), "top-home")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = (home.groupBy("query").agg(F.count("*").alias("n"), F.min_by(F.struct("score", "vec_id"), F.struct("score", -F.col("vec_id"))).alias("last"))
           .where(F.col("n") >= k).select(F.col("query").alias("row"), F.col("last.score").alias("kth"), F.col("last.vec_id").alias("kth_id")))
    away = (queries.join(kth, "row", "left").withColumnRenamed("shard", "home")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard != home"))
    found = home.unionByName(_visits(rows, away, shards, k))
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
