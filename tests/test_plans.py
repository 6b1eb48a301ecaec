"""Plan shape checks: pushdown, pruning, broadcast and skew-safe partitioning."""
import contextlib
import io

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_point_lookup_reads_all_runs_and_filters_by_id(spark):
    """All runs are looked through, by one filter on the id and over the needed columns only."""
    p = plan(E.queries()["run_by_id"](spark, SF_SMALL))
    assert "EqualTo(o_orderkey" not in p and "run_7" in p
    assert "Exchange" not in p and "o_orderpriority" not in p


def test_incremental_high_water_mark_is_pushed_and_target_not_shuffled(spark):
    p = plan(E.queries()["fact_incremental"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts," in p
    assert "SortMergeJoin" not in p


def test_mapping_reads_only_needed_columns(spark):
    p = plan(E.queries()["apply_mapping"](spark, SF_SMALL))
    schemas = [line for line in p.splitlines() if "ReadSchema" in line]
    assert schemas and all("c_acctbal" not in s and "c_mktsegment" not in s for s in schemas)


def test_lookup_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(E.queries()["lookup_join"](spark, SF_SMALL))


def test_duplicate_window_is_bucketed(spark):
    p = plan(E.queries()["duplicate_targets"](spark, SF_SMALL))
    assert "_b" in p and "Window" in p


def test_audit_is_one_pass_per_table(spark):
    p = plan(E.queries()["load_audit"](spark, SF_SMALL))
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", p, flags=re.M)) == 2


def test_hot_key_is_spread_over_tasks(spark):
    """One key holding every row: a plain window puts it in one task, the
    bucketed lag spreads it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from maplift.operators.windows import lag_in_group
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
        plain = df.withColumn("p", F.lag("o").over(Window.partitionBy("k").orderBy("o")))
        split = lag_in_group(df, ["k"], "o", "p", bucket_size=1000)

        def largest_share(d):
            # max(p) keeps the window in the plan (otherwise column pruning drops it)
            sizes = d.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("count"),
                                                                       F.max("p")).collect()
            return max(r["count"] for r in sizes) / 20000
        assert largest_share(plain) == 1.0
        assert largest_share(split) <= 0.5
        assert split.where(F.col("p").isNull()).count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
