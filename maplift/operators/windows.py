"""Skew-safe window-shaped operators.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task;
if one key holds a third of the rows, that task holds a third of the job.
These helpers cut a group into buckets of its order, do the
row-level work per (key, bucket) -- many tasks even for one hot key -- and
carry across buckets through a per-bucket summary.

Buckets are cut in one of two ways:

* by range (default).  The groups are counted first (a partial aggregate of the key columns); when none has more
  rows than a bucket, a plain window is used.  Else keys with more rows than a bucket get edges: quantiles of a
  sample of their own (order value, row hash) pairs.  It makes no difference how the values are spread
  (nanoseconds, hashes, all NULL, all equal): equal order values are told apart by the row hash, so even a
  group of ties is cut.  Other keys are one bucket.  A key has at most ``MAX_BUCKETS``.
* ``dense``: by value, for order columns that count rows (as the row numbers of a sheet); no pass
  over the data is needed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1 << 16
#: Buckets of one key, and sampled rows per bucket that its edges are taken from.
MAX_BUCKETS, SAMPLED = 4096, 24
#: Edges are searched in two steps: groups of this many edges, then within a group.
EDGE_GROUP = 64
_DRAW = 1 << 30


def _dense_bucket(order_col: str, bucket_size: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(bucket_size)).cast("bigint")


def _row_hash(df: DataFrame) -> Column:
    """A hash of a row's content (maps cannot be hashed); equal rows stay together."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def _edges(placed: DataFrame, keys: list[str], bucket_size: int) -> DataFrame:
    """(keys, edges): of each key with more rows than a bucket, the upper bounds of all its buckets but the last,
    in groups of EDGE_GROUP.  Sampled by content, so the same rows have the same edges whenever they are computed."""
    rows = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_size)
    pieces = F.least(F.ceil(F.col("_n") / bucket_size), F.lit(MAX_BUCKETS))
    hot = rows.select(*keys, (pieces * SAMPLED / F.col("_n") * _DRAW).cast("bigint").alias("_draw"), pieces.cast("int").alias("_pieces"))
    drawn = _carried(placed.select(*keys, "_at"), hot, keys, "inner").where(F.pmod(F.xxhash64("_at._h"), F.lit(_DRAW)) < F.col("_draw"))
    sample = drawn.groupBy(*keys, "_pieces").agg(F.sort_array(F.collect_set("_at")).alias("_s"))  # about SAMPLED * MAX_BUCKETS
    step = F.size("_s") / F.col("_pieces")
    picks = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.floor(i * step).cast("int")))
    cut = sample.where(F.col("_pieces") > 1).select(*keys, "_s", picks.alias("_p"))
    cut = cut.select(*keys, F.transform("_p", lambda i: F.get("_s", i)).alias("_e"))
    groups = F.sequence(F.lit(0), ((F.size("_e") - 1) / EDGE_GROUP).cast("int"))
    cut = cut.select(*keys, "_e", groups.alias("_g"))
    return cut.select(*keys, F.transform("_g", lambda g: F.slice("_e", g * EDGE_GROUP + 1, EDGE_GROUP)).alias("_edges"))


def _by_range(df: DataFrame, keys: list[str], order_col: str, bucket_size: int) -> DataFrame:
    """``df`` with its bucket ``_b``, and ``_at``: (order value, row hash), the order of rows within a key."""
    placed = df.withColumn("_at", F.struct(F.col(order_col).alias("_o"), _row_hash(df).alias("_h")))
    with_edges = _carried(placed, _edges(placed, keys, bucket_size), keys)
    # edges below a row: those of full groups, and of the group that its place falls into
    before = F.size(F.filter("_edges", lambda g: F.element_at(g, -1) < F.col("_at")))
    found = with_edges.withColumn("_g", F.coalesce(before, F.lit(0)))
    group = F.coalesce(F.get("_edges", F.col("_g")), F.array().cast(found.schema["_edges"].dataType.elementType))
    within = F.size(F.filter(group, lambda e: e < F.col("_at")))
    return found.withColumn("_b", (F.col("_g") * EDGE_GROUP + within).cast("bigint")).drop("_edges", "_g")


def _small_groups(df: DataFrame, keys: list[str], bucket_size: int) -> bool:
    """Whether no group has more rows than a bucket (one number reaches the driver)."""
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= bucket_size


def _bucketed(df: DataFrame, keys: list[str], order_col: str, bucket_size: int, dense: bool) -> tuple[DataFrame, list[str]]:
    """(``df`` with ``_b``, the columns that order rows within a bucket)."""
    if dense:
        return df.withColumn("_b", _dense_bucket(order_col, bucket_size)), [order_col]
    return _by_range(df, keys, order_col, bucket_size), ["_at"]


def _carried(local: DataFrame, carry: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Join on `cols`; a NULL key or bucket is a group like others, as in a window."""
    renamed = carry.select(*[F.col(c).alias(f"_k_{c}") if c in cols else F.col(c) for c in carry.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return local.join(renamed, cond, how).drop(*[f"_k_{c}" for c in cols])


def lag_in_group(df: DataFrame, keys: Sequence[str], order_col: str, out_col: str,
                 bucket_size: int = DEFAULT_BUCKET, dense: bool = False) -> DataFrame:
    """`out_col` = previous `order_col` value within `keys` (NULL for the first).

    Equal to ``lag(order_col).over(partitionBy(keys).orderBy(order_col))``; rows with equal order
    values follow each other in any order.
    """
    keys = list(keys)
    if not dense and _small_groups(df, keys, bucket_size):
        return df.withColumn(out_col, F.lag(order_col).over(Window.partitionBy(*keys).orderBy(order_col)))
    b, order = _bucketed(df, keys, order_col, bucket_size, dense)
    local = b.withColumn("_prev_local", F.lag(F.struct(order_col)).over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    # a struct is not NULL where the value in it is: NULLs come first, and they are values
    per_bucket = b.groupBy(*keys, "_b").agg(F.max(F.struct(order_col)).alias("_bmax"))
    w_b = Window.partitionBy(*keys).orderBy("_b")
    carry = per_bucket.select(*keys, "_b", F.lag("_bmax").over(w_b).alias("_prev_bucket"))
    return (_carried(local, carry, [*keys, "_b"])
            .withColumn(out_col, F.coalesce("_prev_local", "_prev_bucket")[order_col])
            .drop("_b", "_at", "_prev_local", "_prev_bucket"))


def row_number_in_group(df: DataFrame, keys: Sequence[str], order_col: str, out_col: str,
                        bucket_size: int = DEFAULT_BUCKET, dense: bool = False) -> DataFrame:
    """`out_col` = 1-based position of the row within `keys` by `order_col` (rows with equal order values in any order)."""
    keys = list(keys)
    if not dense and _small_groups(df, keys, bucket_size):
        return df.withColumn(out_col, F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)).cast("bigint"))
    b, order = _bucketed(df, keys, order_col, bucket_size, dense)
    local = b.withColumn("_rn_local", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    per_bucket = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_n").over(w_b), F.lit(0)).alias("_offset"))
    return (_carried(local, carry, [*keys, "_b"])
            .withColumn(out_col, (F.col("_offset") + F.col("_rn_local")).cast("bigint"))
            .drop("_b", "_at", "_rn_local", "_offset"))


def ordered_string_agg(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value: Column,
                       sep: str, out_col: str, bucket_col: str | None = None,
                       bucket_size: int = DEFAULT_BUCKET, count_col: str | None = None) -> DataFrame:
    """`listagg(value, sep) WITHIN GROUP (ORDER BY order_cols)` per `keys`, in two
    levels: partial strings per (key, bucket) first, then the ordered join of
    the partials.  `bucket_col` (default: the last order column) is a numeric
    order column; the order columns before it stay whole in the first level.  NULL values
    are left out; a group of nothing else gives ''.
    With `count_col`, the group's row count comes out of the same two levels."""
    keys = list(keys)
    order_cols = list(order_cols)
    bcol = bucket_col or order_cols[-1]
    lead = order_cols[:order_cols.index(bcol)]
    b = df.select(*keys, *order_cols, value.alias("_v"), _dense_bucket(bcol, bucket_size).alias("_b"))
    has = F.col("_v").isNotNull()
    ordered = F.sort_array(F.collect_list(F.when(has, F.struct(*[F.col(c) for c in order_cols], F.col("_v")))))
    part = (b.groupBy(*keys, *lead, "_b")
            .agg(F.array_join(F.transform(ordered, lambda s: s["_v"]), sep).alias("_part"),
                 F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_m")))
    filled = F.when(F.col("_m") > 0, F.struct(*[F.col(c) for c in lead], F.col("_b"), F.col("_part")))
    aggs = [F.array_join(F.transform(F.sort_array(F.collect_list(filled)), lambda s: s["_part"]), sep).alias(out_col)]
    if count_col:
        aggs.append(F.sum("_n").cast("bigint").alias(count_col))
    return part.groupBy(*keys).agg(*aggs)


def running_sum_in_group(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str],
                         suffix: str = "_cum", bucket_size: int = DEFAULT_BUCKET, dense: bool = False) -> DataFrame:
    """Running sums of `value_cols` within `keys` by `order_col` (inclusive),
    as `<col><suffix>`: a running window per (key, bucket) plus the totals of
    the key's earlier buckets.  Equal to a window over rows; rows with equal order values
    are added in any order.  NULL values add nothing; the sum is NULL until there is a value."""
    keys = list(keys)
    if not dense and _small_groups(df, keys, bucket_size):
        w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(f"{c}{suffix}") for c in value_cols])
    b, order = _bucketed(df, keys, order_col, bucket_size, dense)
    w_in = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(c).over(w_in).alias(f"_l_{c}") for c in value_cols])
    per_bucket = b.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", *[F.sum(f"_t_{c}").over(w_b).alias(f"_o_{c}") for c in value_cols])
    out = _carried(local, carry, [*keys, "_b"])
    for c in value_cols:
        both = F.col(f"_o_{c}") + F.col(f"_l_{c}")
        out = out.withColumn(f"{c}{suffix}", F.coalesce(both, f"_o_{c}", f"_l_{c}"))
    return out.drop("_b", "_at", *[f"_l_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])
