"""Loads that write only the parts their change set touches, and streams that load into a table."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from maplift.operators import load
from maplift.session import fresh_path
from maplift.streaming.incremental import fact_incremental_to_table, file_stream, run_latest_to_table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def bucketed(spark, n=2000, buckets=8):
    root = fresh_path(spark, "bucketed")
    load.full_refresh_load(spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("v"), F.lit(0).alias("ver")), root)
    load.scd1_upsert(spark, root, spark.sql("select cast(0 as bigint) k, 1 v, 1 ver"), ["k"], "ver", buckets=buckets)
    return root


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark):
    root = bucketed(spark)
    before = load._view(load._versions(spark, root))
    assert len(before.parts) == 8 and not before.whole
    bucket = load._dealt(spark.range(2000).withColumnRenamed("id", "k"), ["k"], 8).where("_bucket = 3").select("k")
    twenty = [r.k for r in bucket.orderBy("k").limit(20).collect()]  # 1 % of the keys, all in one bucket
    change = spark.createDataFrame([(k, 5, 7) for k in twenty], "k int, v int, ver int")  # another integer type
    seen = []
    path = load.scd1_upsert(spark, root, change, ["k"], "ver", check=lambda df: seen.append(df.count()))
    after = load._view(load._versions(spark, root))
    assert {v for v in after.parts if after.parts[v] != before.parts[v]} == {"3"} and after.parts["3"] == path
    assert spark.read.parquet(path).count() == bucket.count()  # what was written
    assert seen == [2000]  # the check saw the whole new version
    want = {k: (5, 7) if k in twenty else (1, 1) if k == 0 else (0, 0) for k in range(2000)}
    assert {r.k: (r.v, r.ver) for r in load.read_current(spark, root).collect()} == want
    assert load.read_current(spark, root).columns == ["k", "v", "ver"]


def test_upsert_of_new_null_and_no_keys(spark):
    root = bucketed(spark, n=3)
    n = load._base(spark, root)
    assert load.scd1_upsert(spark, root, spark.sql("select cast(1 as bigint) k, 1 v, 1 ver where false"), ["k"], "ver") is None
    assert load._base(spark, root) == n
    for change in ([(None, 9, 1), (77, 9, 1)], [(None, 10, 2)]):
        load.scd1_upsert(spark, root, spark.createDataFrame(change, "k long, v int, ver int"), ["k"], "ver")
    assert rows_of(load.read_current(spark, root)) == sorted([(0, 1, 1), (1, 0, 0), (2, 0, 0), (None, 10, 2), (77, 9, 1)], key=str)
    load.append_load(spark.sql("select cast(500 as bigint) k, 1 v, 1 ver"), root)  # rows outside the buckets
    assert load.read_current(spark, root).count() == 6
    load.scd1_upsert(spark, root, spark.sql("select cast(500 as bigint) k, 2 v, 2 ver"), ["k"], "ver", buckets=4)
    assert load.read_current(spark, root).where("k = 500").first().v == 2
    view = load._view(load._versions(spark, root))
    assert not view.whole and view.layout == "_bucket/4/k"
    with pytest.raises(load.LoadError, match="no committed version"):
        load.scd1_upsert(spark, fresh_path(spark, "none"), spark.range(1), ["id"], "id")


def test_a_grown_table_is_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(load, "BUCKET_ROWS", 10)
    root = fresh_path(spark, "grown")
    for n in (5, 40, 41, 60):
        load.keep_latest(spark, root, spark.range(n).withColumn("v", F.lit(n)), ["id"], "v")
        view = load._view(load._versions(spark, root))
        assert load.read_current(spark, root).count() == n == sum(view.rows.values())
    assert [v.kind for v in load._versions(spark, root)] == ["refresh", "replace", "replace", "refresh"]
    assert view.layout == "_bucket/5/id"


def test_a_failed_check_keeps_the_old_parts(spark):
    root = bucketed(spark, n=50)

    def refuse(df):
        raise load.LoadError("no")
    before = load.current_files(spark, root)
    with pytest.raises(load.LoadError, match="no"):
        load.scd1_upsert(spark, root, spark.sql("select cast(1 as bigint) k, 1 v, 1 ver"), ["k"], "ver", check=refuse)
    assert load.current_files(spark, root) == before


def test_replaced_days_leave_the_others_where_they_are(spark):
    root = fresh_path(spark, "days")
    events = spark.sql("select id, timestamp_seconds(id * 43200) as ts from range(10)")
    first = load.partitioned_load(events, root, "ts")
    second = load.replace_partitions(events.where("id = 2").withColumn("id", F.lit(99).cast("bigint")), root, "ts")
    view = load._view(load._versions(spark, root))
    assert {f for f in view.parts.values()} == {first, second}
    assert [v for v, f in view.parts.items() if f == second] == ["1970-01-02"]
    got = load.read_current(spark, root)
    assert sorted((r.id, str(r.dt)) for r in got.collect()) == sorted(
        (i, str(dt.date(1970, 1, 1) + dt.timedelta(days=i // 2))) for i in [0, 1, 4, 5, 6, 7, 8, 9]) + [(99, "1970-01-02")]
    n = load._base(spark, root)
    load.replace_partitions(events.where("false"), root, "ts")
    assert load._base(spark, root) == n
    new_day = events.where("id = 9").withColumn("ts", F.lit("2001-05-05").cast("timestamp"))
    load.replace_partitions(new_day, root, "ts")
    assert load.read_current(spark, root).where("dt = '2001-05-05'").count() == 1 and load.read_current(spark, root).count() == 10


def test_latest_state_batches_touch_only_their_buckets(spark):
    base = fresh_path(spark, "state")
    inbox, table, ckpt = f"{base}/inbox", f"{base}/table", f"{base}/ckpt"
    schema = "run string, field string, value int, seq long"
    batches = [[(f"r{i}", "f", i, 1) for i in range(300)], [("r7", "f", 70, 5), ("r7", "f", 60, 4)], [("r7", "f", 1, 2), ("new", "f", 3, 1)], []]
    written = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        before = load._base(spark, table)
        run_latest_to_table(file_stream(spark, inbox, spark.createDataFrame([], schema).schema), table, ckpt, ["run", "field"], "seq", buckets=16)
        view = load._view(load._versions(spark, table))
        written.append(sum(f == load._versions(spark, table)[-1].folder for f in view.parts.values()) if load._base(spark, table) > before else 0)
    assert written[0] == 16 and written[1] == 1 and written[2] <= 2 and written[3] == 0
    got = {r.run: (r.value, r.seq) for r in load.read_current(spark, table).collect()}
    assert got == {f"r{i}": (i, 1) for i in range(300)} | {"r7": (70, 5), "new": (3, 1)}


def test_empty_tables_in_parts(spark):
    none = spark.sql("select cast(1 as bigint) id, timestamp_seconds(1) ts where false")
    days, keyed = fresh_path(spark, "no_days"), fresh_path(spark, "no_keys")
    load.partitioned_load(none, days, "ts")
    assert load.read_current(spark, days).columns == ["id", "ts", "dt"] and load.read_current(spark, days).count() == 0
    load.replace_partitions(spark.sql("select cast(1 as bigint) id, timestamp_seconds(1) ts"), days, "ts")
    assert [r.id for r in load.read_current(spark, days).collect()] == [1]
    load.keep_latest(spark, keyed, none, ["id"], "ts")
    assert load.read_current(spark, keyed).columns == ["id", "ts"] and load.read_current(spark, keyed).count() == 0
    load.keep_latest(spark, keyed, spark.sql("select cast(1 as bigint) id, timestamp_seconds(1) ts"), ["id"], "ts", buckets=2)
    assert load._view(load._versions(spark, keyed)).layout == "_bucket/2/id"


T = "timestamp'2024-0{}'"


def test_stream_remembers_every_loaded_key(spark):
    """A loaded key that comes again with a later time, long after the watermark has passed it, is not loaded twice."""
    base = fresh_path(spark, "facts")
    inbox, table, ckpt = f"{base}/inbox", f"{base}/table", f"{base}/ckpt"

    def rows(*r):
        return spark.sql(" union all ".join(f"select cast({i} as bigint) id, {T.format(d)} ts" for i, d in r))

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(inbox)
        fact_incremental_to_table(file_stream(spark, inbox, df.schema), table, ckpt, "ts", ["id"], "2 days")
        return sorted(r.id for r in load.read_current(spark, table).collect())
    loaded = rows((1, "1-01"), (2, "1-02"), (3, "1-03"), (9, "2-01"))
    assert arrive(loaded) == [1, 2, 3, 9]
    # 1 again inside the window, a new late key, a new key at the window's edge, a key twice in one batch
    new = rows((1, "2-02"), (4, "1-05"), (5, "1-30"), (6, "2-03"), (6, "2-04"))
    want = sorted(r.id for r in loaded.unionByName(load.fact_incremental(new, loaded, "ts", ["id"], "2 days")).collect())
    assert arrive(new) == want == [1, 2, 3, 5, 6, 9]
    n = load._base(spark, table)
    # a restart without new files
    fact_incremental_to_table(file_stream(spark, inbox, new.schema), table, ckpt, "ts", ["id"], "2 days")
    assert load._base(spark, table) == n
    # a batch that had committed its rows but not its checkpoint is run again: its line is found
    notes = load.noted_batches(spark, table)
    assert f"{ckpt}#0" in notes and f"{ckpt}#1" in notes
    # a new stream (new checkpoint) over all the files adds nothing either
    fact_incremental_to_table(file_stream(spark, inbox, new.schema), table, f"{base}/ckpt2", "ts", ["id"], "2 days")
    assert sorted(r.id for r in load.read_current(spark, table).collect()) == want
