"""Queries: streaming forms of the incremental loads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.operators.load import read_current
from maplift.plans.registry import query
from maplift.session import fresh_path
from maplift.sources import derived
from maplift.sources.tables import read_table
from maplift.streaming.attempts import route_attempts_to_table
from maplift.streaming.incremental import (fact_incremental_to_table, feed_entries, file_stream, known_updates, run_available,
                                           run_latest_to_table)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema)


def _repeats(events: DataFrame) -> DataFrame:
    """Loaded events sent again a month later, with a time of then: on time, but their keys are loaded."""
    return (events.where((F.col("event_id") % 100 == 1) & (F.col("ts") < F.lit(derived.LATE_CUTOFF).cast("timestamp_ntz")))
            .withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")))


@query("fact_incremental_stream")
def q_fact_incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches into a table: the rows loaded before, then every event (late and repeated rows among them),
    then loaded events again with a new time."""
    base = fresh_path(spark, "streams/fact_events")
    inbox, table, ckpt = f"{base}/inbox", f"{base}/table", f"{base}/checkpoint"
    events = read_table(spark, sf_dir, "events")
    for arrived in (derived.fact_target_before(spark, sf_dir), events, _repeats(events)):
        arrived.write.mode("append").parquet(inbox)
        fact_incremental_to_table(file_stream(spark, inbox, events.schema), table, ckpt, "ts", ["event_id"], "2 days")
    return read_current(spark, table)


@query("feed_append_stream")
def q_feed_append_stream(spark, sf_dir):
    base = fresh_path(spark, "streams/run_feed")
    run_available(feed_entries(_events_stream(spark, sf_dir)), f"{base}/sink", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/sink")


@query("latest_run_state_stream")
def q_latest_run_state_stream(spark, sf_dir):
    base = fresh_path(spark, "streams/run_state")
    updates = _events_stream(spark, sf_dir).select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq"))
    run_latest_to_table(known_updates(updates, derived.runs(spark, sf_dir)), f"{base}/table", f"{base}/checkpoint",
                        ["run_id", "field"], "seq")
    return read_current(spark, f"{base}/table")


#: A run to be tried again fails after three days without an attempt.
PATIENCE_MS = 3 * 86_400_000


@query("attempt_routing_stream")
def q_attempt_routing_stream(spark, sf_dir):
    """J5 by run as its attempts arrive, with timers: runs without a next attempt have failed."""
    base = fresh_path(spark, "streams/routing")
    e = _events_stream(spark, sf_dir)
    attempts = e.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), "ts",
                        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise("").alias("error"))
    route_attempts_to_table(attempts, f"{base}/table", f"{base}/checkpoint", ["user_id", "day"], "ts", "1 day", PATIENCE_MS)
    return read_current(spark, f"{base}/table").select("user_id", "day", "attempt", "error", "route")
