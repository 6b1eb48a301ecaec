"""Routing of runs as a stream: timers, late attempts, restarts."""
from pyspark.sql import functions as F

from maplift.operators.load import read_current
from maplift.session import fresh_path
from maplift.streaming.attempts import merge_attempts, route_attempts_to_table
from maplift.streaming.incremental import file_stream

DAY = 86_400_000


def test_routes_change_as_attempts_and_time_arrive(spark):
    base = fresh_path(spark, "routing")
    inbox, table, ckpt = f"{base}/inbox", f"{base}/table", f"{base}/ckpt"
    schema = "run string, seq long, error string, day int"

    def arrive(*rows):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
        df.coalesce(1).write.mode("append").parquet(inbox)
        stream = file_stream(spark, inbox, df.schema)
        route_attempts_to_table(stream, table, ckpt, ["run"], "ts", "1 day", 3 * DAY, max_attempts=3)
        return {r.run: (r.attempt, r.error, r.route) for r in read_current(spark, table).collect()}

    got = arrive(("a", 1, "bad", 10), ("b", 2, "", 10), ("c", 3, "x", 10), ("c", 4, "y", 10), ("c", 5, "z", 10), ("d", 7, "late", 10), ("d", 6, "", 10),
                 (None, 8, None, 10))
    assert got == {"a": (1, "bad", "retry"), "b": (1, "", "review"), "c": (3, "z", "escalate"), "d": (2, "late", "retry"), None: (1, None, "retry")}
    got = arrive(("d", 9, "", 13), ("e", 10, "new", 13))  # watermark: day 12, timers end on day 13
    assert got["a"] == (1, "bad", "retry") and got["d"] == (3, "", "review") and got["e"] == (1, "new", "retry")
    got = arrive(("f", 11, "", 15))  # watermark: day 14: a waited for too long, e has until day 16
    assert got["a"] == (1, "bad", "failed") and got[None] == (1, None, "failed")
    assert got["b"] == (1, "", "review") and got["c"] == (3, "z", "escalate") and got["e"] == (1, "new", "retry")
    got = arrive(("a", 12, "again", 15), ("b", 1, "too late", 2))  # counted on; a row behind the watermark is dropped
    assert got["a"] == (2, "again", "retry") and got["b"] == (1, "", "review")
    before = got
    got = arrive()  # nothing new
    assert got == before
    got = arrive(("z", 99, "", 40))
    assert got["a"] == (2, "again", "failed") and got["e"] == (1, "new", "failed") and got["z"] == (1, "", "review")


def test_batches_equal_a_replay_in_order_and_count_once(spark):
    root, state, mark, seq, met = fresh_path(spark, "routing-replay"), {}, None, 0, set()
    schema = "run long, day long, seq long, error string, ts timestamp"
    for epoch, days in enumerate(((5, 6, 7), (6, 9), (3, 8, 12), (22,))):
        rows = []
        for day in days:
            for run in range(0, 60, 1 + day % 4):
                seq += 1
                rows.append((run, run % 2, seq, ("", "bad", None)[(run + day) % 3], day * 86400))
        df = spark.createDataFrame(rows, "run long, day long, seq long, error string, at long").withColumn("at", F.timestamp_seconds("at"))
        batch = df.withColumnRenamed("at", "ts")
        assert batch.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        for _ in range(2):  # a batch that is run again changes nothing
            merge_attempts(batch, root, ["run", "day"], "ts", "1 day", 3 * DAY, 3, f"s#{epoch}")
        rows = [r for r in rows if mark is None or r[4] * 1000 > mark]
        for run, key, n, error, at in rows:
            count, _, last = state.get((run, key), (0, None, 0))
            state[run, key] = (count + 1, error, max(last, at * 1000))
        mark = max(x[2] for x in state.values()) - DAY
        want = {k: (n, e, "review" if e == "" else "escalate" if n >= 3 else "failed" if ms + 3 * DAY < mark else "retry")
                for k, (n, e, ms) in state.items()}
        assert {(r.run, r.day): (r.attempt, r.error, r.route) for r in read_current(spark, root).collect()} == want
        met |= {x[2] for x in want.values()}
    assert met == {"failed", "escalate", "review", "retry"}
