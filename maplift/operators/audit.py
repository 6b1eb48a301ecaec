"""Load audits.

The audit is fused: one aggregate pass over the source (count) and one over
the target (count + one `count_if(col IS NULL)` per required column),
instead of one query per check.  Both aggregates are single rows, combined
by a union and a second tiny aggregate (no cross join).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maplift.model import AUDIT_COUNT_FAIL, AUDIT_NULL_FAIL


def _null_col(i: int) -> str:
    return f"_n{i}"


def _audit_counts(source: DataFrame, target: DataFrame, required: Sequence[str]) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    s = source.agg(F.count(F.lit(1)).alias("source_rows"), zero.alias("rows_written"),
                   *[zero.alias(_null_col(i)) for i in range(len(required))])
    t = target.agg(zero.alias("source_rows"), F.count(F.lit(1)).alias("rows_written"),
                   *[F.count_if(F.col(c).isNull()).cast("bigint").alias(_null_col(i))
                     for i, c in enumerate(required)])
    both = s.unionByName(t)
    return both.agg(*[F.sum(c).cast("bigint").alias(c) for c in both.columns])


def load_audit(source: DataFrame, target: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: source_rows, rows_written, counts_match, null_violations,
    bad_col (first required column with NULLs, schema order), ok, failed_check."""
    required = list(required)
    c = _audit_counts(source, target, required)
    nulls = [F.col(_null_col(i)) for i in range(len(required))]
    total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0).cast("bigint")
    bad = F.coalesce(*[F.when(n > 0, F.lit(name)) for n, name in zip(nulls, required)], F.lit(None)) \
        if required else F.lit(None).cast("string")
    out = c.select(
        "source_rows", "rows_written",
        (F.col("source_rows") == F.col("rows_written")).alias("counts_match"),
        total.cast("bigint").alias("null_violations"),
        bad.cast("string").alias("bad_col"))
    ok = F.col("counts_match") & (F.col("null_violations") == 0)
    return out.select(
        "*", ok.alias("ok"),
        F.when(ok, F.lit(None).cast("string"))
         .when(~F.col("counts_match"), F.lit(AUDIT_COUNT_FAIL))
         .otherwise(F.concat(F.lit(AUDIT_NULL_FAIL.split("{}")[0]), F.col("bad_col"),
                             F.lit(AUDIT_NULL_FAIL.split("{}")[1]))).alias("failed_check"))


def null_violations(target: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: (ordinal, column_name, null_count)."""
    required = list(required)
    agg = target.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(_null_col(i))
                       for i, c in enumerate(required)])
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                 F.col(_null_col(i)).alias("null_count")) for i, c in enumerate(required)])).alias("r"))
    return stacked.select("r.ordinal", "r.column_name", "r.null_count")


def null_rows(target: DataFrame, required: Sequence[str]) -> DataFrame:
    """C4: rows with a NULL in any required column."""
    cond = None
    for c in required:
        cond = F.col(c).isNull() if cond is None else cond | F.col(c).isNull()
    return target.where(cond)


_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
    T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def _width(field: T.StructField) -> Column:
    c = F.col(field.name)
    dt = field.dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    w = next((v for k, v in _FIXED_WIDTH.items() if isinstance(dt, k)), 8)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(w)).cast("bigint")


def volume_estimate(df: DataFrame) -> DataFrame:
    """Rows, bytes (sum of value widths) and GB (1e9, 4 decimals)."""
    width = None
    for f in df.schema.fields:
        w = _width(f)
        width = w if width is None else width + w
    out = df.agg(F.count(F.lit(1)).alias("est_rows"), F.coalesce(F.sum(width), F.lit(0)).cast("bigint")
                 .alias("est_bytes"))
    return out.select("est_rows", "est_bytes", F.round(F.col("est_bytes") / F.lit(1e9), 4).alias("est_gb"))


def row_count(df: DataFrame) -> DataFrame:
    """Rows in a table, as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
