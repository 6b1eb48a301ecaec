"""Late and repeated events in the streaming incremental append."""
from pyspark.sql import functions as F

from maplift.session import fresh_path
from maplift.sources.tables import read_table
from maplift.streaming.incremental import fact_incremental_stream, file_stream, run_available
from tests.conftest import SF_SMALL


def test_late_and_duplicate_events_are_dropped(spark):
    ev = read_table(spark, SF_SMALL, "events")
    ts = F.col("ts")
    a = ev.where((ts >= "2024-01-10") & (ts < "2024-01-20"))
    late = ev.where(ts < "2024-01-10")
    c = ev.where(ts >= "2024-01-20").unionByName(a.where(F.col("event_id") % 2 == 0))
    base = fresh_path(spark, "test_stream")
    inbox, sink, ckpt = f"{base}/inbox", f"{base}/sink", f"{base}/ckpt"
    for batch in (a, late, c):  # arrival order: middle, old (late), new + repeats
        batch.coalesce(1).write.mode("append").parquet(inbox)
        run_available(fact_incremental_stream(file_stream(spark, inbox, ev.schema), "ts", ["event_id"], "2 days"),
                      sink, ckpt)
    out = spark.read.parquet(sink)
    got = sorted(r.event_id for r in out.collect())
    want = sorted(r.event_id for r in a.unionByName(ev.where(ts >= "2024-01-20")).collect())
    assert got == want
    assert len(got) == len(set(got))


def test_restart_with_same_checkpoint_adds_nothing(spark):
    """A stream restarted from its checkpoint resumes: files already processed
    are not appended again (file sink + checkpoint, exactly once)."""
    from maplift.streaming.incremental import feed_entries
    ev = read_table(spark, SF_SMALL, "events")
    base = fresh_path(spark, "test_restart")
    inbox, sink, ckpt = f"{base}/inbox", f"{base}/sink", f"{base}/ckpt"
    ev.coalesce(1).write.mode("append").parquet(inbox)
    for _ in range(2):  # the second run is a restart with nothing new
        run_available(feed_entries(file_stream(spark, inbox, ev.schema)), sink, ckpt)
    assert spark.read.parquet(sink).count() == ev.count()
    ev.where(F.col("event_id") < 10).coalesce(1).write.mode("append").parquet(inbox)
    run_available(feed_entries(file_stream(spark, inbox, ev.schema)), sink, ckpt)
    assert spark.read.parquet(sink).count() == ev.count() + ev.where(F.col("event_id") < 10).count()
