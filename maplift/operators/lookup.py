"""Code -> name through a lookup table; Spark broadcasts it when it measures small."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def dedup_lookup(lookup: DataFrame, key: str = "code", value: str = "name") -> DataFrame:
    """One value per key (smallest), so a join cannot multiply rows."""
    return lookup.groupBy(key).agg(F.min(value).alias(value))


def lookup_join(df: DataFrame, lookup: DataFrame, code_col: str, out_col: str, default: str,
                key: str = "code", value: str = "name") -> DataFrame:
    lk = dedup_lookup(lookup, key, value)
    joined = df.join(lk, df[code_col] == lk[key], "left")
    return joined.select(*[df[c] for c in df.columns],
                         F.coalesce(lk[value], F.lit(default)).alias(out_col))
