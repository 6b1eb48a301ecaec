"""Run-history analytics.

`runs` has one row per run; `run_feed` one row per feed entry; `attempts`
one row per generation attempt.  All jobs are grouped aggregates or
per-row projections; positions inside a run use the skew-safe bucketed
row number, so one very long run does not land in a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.functions.text import format_duration, time_ago
from maplift.model import MAX_ATTEMPTS, PRICE_IN_PER_M, PRICE_OUT_PER_M, STEP_COUNT
from maplift.operators.windows import row_number_in_group, running_sum_in_group


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """Point lookup (pushed down to the scan as an equality filter)."""
    return runs.where(F.col("run_id") == F.lit(run_id))


def require_run(runs: DataFrame, run_id: str) -> dict:
    """C5 for one caller: the run's row, or LookupError when there is none."""
    rows = run_by_id(runs, run_id).take(1)
    if not rows:
        raise LookupError(f"Run {run_id} not found")
    return rows[0].asDict()


def run_kpis(runs: DataFrame) -> DataFrame:
    """E5: total, awaiting review, success rate (%), average duration."""
    st = F.col("status")
    agg = runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(st == "awaiting_review").alias("awaiting_review"),
        F.count_if(st == "succeeded").alias("_ok"),
        F.count_if(st == "failed").alias("_bad"),
        F.avg(F.col("duration_sec")).alias("_avg"))
    fin = F.col("_ok") + F.col("_bad")
    rate = F.when(fin > 0, F.floor(F.col("_ok").cast("double") / fin * 100 + 0.5)).otherwise(F.lit(0))
    avg_sec = F.floor(F.col("_avg") + 0.5).cast("bigint")
    return agg.select("total_runs", "awaiting_review", rate.cast("bigint").alias("success_rate"),
                      avg_sec.alias("avg_duration_sec"), format_duration(avg_sec).alias("avg_duration"))


def usage_cost(attempts: DataFrame, run_keys: list[str]) -> DataFrame:
    """prompt/completion units summed per run and the cost (4 decimals)."""
    agg = attempts.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("prompt_units").cast("bigint").alias("prompt_units"),
        F.sum("completion_units").cast("bigint").alias("completion_units"))
    cost = (F.col("prompt_units") * F.lit(PRICE_IN_PER_M) + F.col("completion_units") * F.lit(PRICE_OUT_PER_M)) \
        / F.lit(1_000_000.0)
    return agg.withColumn("cost_usd", F.round(cost, 4))


def usage_running(attempts: DataFrame, run_keys: list[str], order_col: str = "seq") -> DataFrame:
    """E6 running form: units and cost accumulated over a run's attempts."""
    cum = running_sum_in_group(attempts, run_keys, order_col, ["prompt_units", "completion_units"])
    cost = (F.col("prompt_units_cum") * F.lit(PRICE_IN_PER_M)
            + F.col("completion_units_cum") * F.lit(PRICE_OUT_PER_M)) / F.lit(1_000_000.0)
    return cum.select(*run_keys, order_col, F.col("prompt_units_cum").cast("bigint").alias("prompt_units_cum"),
                      F.col("completion_units_cum").cast("bigint").alias("completion_units_cum"),
                      F.round(cost, 4).alias("cost_usd_cum"))


def number_attempts(attempts: DataFrame, run_keys: list[str], order_col: str = "seq") -> DataFrame:
    return row_number_in_group(attempts, run_keys, order_col, "attempt")


def latest_attempt(numbered: DataFrame, run_keys: list[str]) -> DataFrame:
    """last attempt number and its error per run."""
    return numbered.groupBy(*run_keys).agg(
        F.max("attempt").alias("attempt"),
        F.max_by("error", "attempt").alias("error"))


def attempt_routing(latest: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """No error -> review; error at the last allowed attempt -> escalate;
    else retry."""
    route = (F.when(F.col("error") == "", F.lit("review"))
             .when(F.col("attempt") >= max_attempts, F.lit("escalate"))
             .otherwise(F.lit("retry")))
    return latest.withColumn("route", route)


def run_listing(runs: DataFrame) -> DataFrame:
    """G1: all runs, newest first (run id breaks ties)."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id"))


def feed_timeline(feed: DataFrame) -> DataFrame:
    """Each run's feed entries numbered in insertion order."""
    return row_number_in_group(feed, ["run_id"], "seq", "position")


def run_step_states(runs: DataFrame, steps: int = STEP_COUNT) -> DataFrame:
    """One row per (run, step) with done/active/failed/pending."""
    st, cur, i = F.col("status"), F.col("current_step"), F.col("step")
    state = (F.when(st == "succeeded", F.lit("done"))
             .when(i < cur, F.lit("done"))
             .when((i == cur) & (F.col("step_failed") | st.isin("failed", "rejected")), F.lit("failed"))
             .when(i == cur, F.lit("active"))
             .otherwise(F.lit("pending")))
    return (runs.select("run_id", "status", "current_step", "step_failed",
                        F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
            .select("run_id", F.col("step").cast("int").alias("step"), state.alias("state")))


def run_files(runs: DataFrame) -> DataFrame:
    """I4: number of uploaded files and their names joined."""
    return runs.select("run_id", F.size("file_names").cast("int").alias("n_files"),
                       F.array_join("file_names", ", ").alias("files"))


def latest_run_state(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """Last write per (run, field) wins; writes to unknown runs are ignored.

    The grouped `max_by` runs first: it is a partial aggregate, so each task
    reduces its share of a hot run before the shuffle, and only one row per
    (run, field) meets the semi-join with `runs` (same result, since the
    filter is on a grouping key)."""
    latest = updates.groupBy("run_id", "field").agg(F.max_by("value", "seq").alias("value"),
                                                    F.max("seq").alias("seq"))
    return latest.join(runs.select("run_id"), "run_id", "left_semi")


def duration_text(runs: DataFrame) -> DataFrame:
    """B20 over runs."""
    return runs.select("run_id", "duration_sec", format_duration(F.col("duration_sec")).alias("duration"))


def started_ago(runs: DataFrame, now_ms: int | Column) -> DataFrame:
    """B21 over runs; `now_ms` is a parameter so results are reproducible."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms).cast("bigint")
    return runs.select("run_id", "started_at", time_ago(F.col("started_at"), now).alias("ago"))


def run_documents(runs: DataFrame) -> DataFrame:
    """Run row -> the nested run document, as JSON text.

    `feed` (id, ts, kind, text) and `findings` (id, severity, rows, message) are the
    arrays that the run row holds; they are bounded by what one run records.

    `attempt` is an object only when both numbers are set, `audit` only when
    rows written is set; optional keys are left out when unset."""
    attempt = F.when(F.col("attempt_current").isNotNull() & F.col("attempt_max").isNotNull(),
                     F.struct(F.lit(3).alias("step"), F.col("attempt_current").alias("current"),
                              F.col("attempt_max").alias("max")))
    audit = F.when(F.col("audit_rows_written").isNotNull(), F.struct(
        F.col("audit_rows_written").alias("rowsWritten"),
        F.coalesce(F.col("audit_counts_match"), F.lit(False)).alias("countsMatch"),
        F.coalesce(F.col("audit_nulls_check"), F.lit(False)).alias("nullsCheck"),
        F.nullif(F.col("audit_failed_check"), F.lit("")).alias("failedCheck")))
    meta = F.struct(
        F.coalesce(F.col("file_names"), F.array().cast("array<string>")).alias("files"),
        F.coalesce(F.col("llm_attempts"), F.lit(0)).alias("llmAttempts"),
        F.coalesce(F.col("llm_prompt_tokens"), F.lit(0)).alias("llmPromptTokens"),
        F.coalesce(F.col("llm_completion_tokens"), F.lit(0)).alias("llmCompletionTokens"),
        F.coalesce(F.col("llm_cost_usd"), F.lit(0.0)).alias("llmCostUsd"),
        F.nullif(F.col("created_by"), F.lit("")).alias("createdBy"),
        F.nullif(F.col("approved_by"), F.lit("")).alias("approvedBy"),
        F.nullif(F.col("workflow_id"), F.lit("")).alias("workflowId"))
    head = F.struct(
        F.col("run_id").alias("id"),
        F.coalesce(F.col("target_table"), F.lit("")).alias("targetTable"),
        F.col("status").alias("status"),
        F.coalesce(F.col("mappings_validated"), F.lit(0)).alias("mappingsValidated"),
        F.coalesce(F.col("mappings_excluded"), F.lit(0)).alias("mappingsExcluded"),
        F.col("cost_gb").alias("costGb"),
        F.col("cost_usd").alias("costUsd"),
        F.coalesce(F.col("started_at"), F.lit(0)).alias("startedAt"),
        F.col("duration_sec").alias("durationSec"),
        F.coalesce(F.col("current_step"), F.lit(0)).alias("currentStep"),
        F.coalesce(F.col("step_failed"), F.lit(False)).alias("stepFailed"),
        attempt.alias("attempt"),
        F.coalesce(F.col("feed"), F.array().cast(runs.schema["feed"].dataType)).alias("feed"),
        F.coalesce(F.col("findings"), F.array().cast(runs.schema["findings"].dataType)).alias("findings"),
        F.coalesce(F.col("sqlx_code"), F.lit("")).alias("sqlx"),
        F.coalesce(F.col("sqlx_path"), F.lit("")).alias("sqlxPath"))
    # top-level keys keep their nulls; inside `audit` and `meta` an unset
    # optional key is left out (the only nullable fields there)
    head_json = F.to_json(head, {"ignoreNullFields": "false"})
    return runs.select("run_id", head_json.alias("_h"), audit.alias("_a"), meta.alias("_m")).select(
        "run_id", F.concat(F.expr("substring(_h, 1, length(_h) - 1)"),
                           F.lit(',"audit":'), F.coalesce(F.to_json("_a"), F.lit("null")),
                           F.lit(',"meta":'), F.to_json("_m"), F.lit("}")).alias("doc"))
