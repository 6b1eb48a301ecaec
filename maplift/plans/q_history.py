"""Queries: run history."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from maplift.operators import history as H
from maplift.plans.registry import query
from maplift.sources import derived

ATTEMPT_RUN = ["user_id", "day"]
# Fixed "now" for relative times (reproducible results).
NOW_MS = int(dt.datetime(2001, 8, 2, tzinfo=dt.timezone.utc).timestamp() * 1000)
LOOKUP_RUN_ID = "run_7"


@query("run_by_id")
def q_run_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.run_by_id(derived.runs(spark, sf_dir), LOOKUP_RUN_ID).select(
        "run_id", "target_table", "status", "current_step", "started_at", "duration_sec")


@query("run_kpis")
def q_run_kpis(spark, sf_dir):
    return H.run_kpis(derived.runs(spark, sf_dir))


@query("usage_cost")
def q_usage_cost(spark, sf_dir):
    return H.usage_cost(derived.attempts(spark, sf_dir), ATTEMPT_RUN)


@query("usage_running")
def q_usage_running(spark, sf_dir):
    return H.usage_running(derived.attempts(spark, sf_dir), ATTEMPT_RUN)


@query("latest_attempt")
def q_latest_attempt(spark, sf_dir):
    numbered = H.number_attempts(derived.attempts(spark, sf_dir), ATTEMPT_RUN)
    return H.latest_attempt(numbered, ATTEMPT_RUN)


@query("attempt_routing")
def q_attempt_routing(spark, sf_dir):
    numbered = H.number_attempts(derived.attempts(spark, sf_dir), ATTEMPT_RUN)
    return H.attempt_routing(H.latest_attempt(numbered, ATTEMPT_RUN))


@query("run_listing")
def q_run_listing(spark, sf_dir):
    return H.run_listing(derived.runs(spark, sf_dir)).select("run_id", "started_at", "status", "target_table")


@query("run_documents")
def q_run_documents(spark, sf_dir):
    return H.run_documents(derived.runs(spark, sf_dir))


@query("feed_timeline")
def q_feed_timeline(spark, sf_dir):
    return H.feed_timeline(derived.run_feed(spark, sf_dir))


@query("run_step_states")
def q_run_step_states(spark, sf_dir):
    return H.run_step_states(derived.runs(spark, sf_dir))


@query("run_files")
def q_run_files(spark, sf_dir):
    return H.run_files(derived.runs(spark, sf_dir))


@query("latest_run_state")
def q_latest_run_state(spark, sf_dir):
    return H.latest_run_state(derived.run_state_updates(spark, sf_dir), derived.runs(spark, sf_dir))


@query("format_duration")
def q_format_duration(spark, sf_dir):
    return H.duration_text(derived.runs(spark, sf_dir))


@query("time_ago")
def q_time_ago(spark, sf_dir):
    return H.started_ago(derived.runs(spark, sf_dir), NOW_MS)
