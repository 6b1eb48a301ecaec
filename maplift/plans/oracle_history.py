"""DuckDB SQL for the run-history queries."""
from __future__ import annotations

from maplift.plans.oracle_inputs import ATTEMPTS, RUN_FEED, RUNS, with_
from maplift.plans.q_history import NOW_MS


def _fmt_duration(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN '—' WHEN {d} // 60 = 0 THEN CAST({d} % 60 AS VARCHAR) || 's' "
            f"ELSE CAST({d} // 60 AS VARCHAR) || 'm ' || lpad(CAST({d} % 60 AS VARCHAR), 2, '0') || 's' END")


def _jsround(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


_S = f"greatest(1, {_jsround(f'({NOW_MS} - started_at) / 1000.0')})"
_M = _jsround(f"{_S} / 60.0")
_H = _jsround(f"{_M} / 60.0")
_D = _jsround(f"{_H} / 24.0")

_ROUTE = with_(ATTEMPTS, """latest AS (SELECT user_id, day, max(attempt) AS attempt, arg_max(error, attempt) AS error
  FROM attempts GROUP BY user_id, day)""")

ORACLE_HISTORY = {
    "run_by_id": with_(RUNS) + (
        "SELECT run_id, target_table, status, current_step, started_at, duration_sec FROM runs "
        "WHERE run_id = 'run_7'"),
    "run_kpis": with_(RUNS) + f"""
SELECT total_runs, awaiting_review,
  CAST(CASE WHEN ok + bad > 0 THEN floor(CAST(ok AS DOUBLE) / (ok + bad) * 100 + 0.5) ELSE 0 END AS BIGINT)
    AS success_rate,
  {_jsround('av')} AS avg_duration_sec, {_fmt_duration(_jsround('av'))} AS avg_duration
FROM (SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'awaiting_review') AS awaiting_review,
  count(*) FILTER (WHERE status = 'succeeded') AS ok, count(*) FILTER (WHERE status = 'failed') AS bad,
  avg(duration_sec) AS av FROM runs)""",
    "usage_cost": with_(ATTEMPTS) + """
SELECT user_id, day, count(*) AS attempts, CAST(sum(prompt_units) AS BIGINT) AS prompt_units,
  CAST(sum(completion_units) AS BIGINT) AS completion_units,
  round((CAST(sum(prompt_units) AS BIGINT) * 0.59 + CAST(sum(completion_units) AS BIGINT) * 0.79) / 1000000.0, 4)
    AS cost_usd
FROM attempts GROUP BY user_id, day""",
    "usage_running": with_(ATTEMPTS) + """
SELECT user_id, day, seq, CAST(pc AS BIGINT) AS prompt_units_cum, CAST(cc AS BIGINT) AS completion_units_cum,
  round((CAST(pc AS BIGINT) * 0.59 + CAST(cc AS BIGINT) * 0.79) / 1000000.0, 4) AS cost_usd_cum
FROM (SELECT user_id, day, seq,
  sum(prompt_units) OVER (PARTITION BY user_id, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc,
  sum(completion_units) OVER (PARTITION BY user_id, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS cc
  FROM attempts)""",
    "latest_attempt": _ROUTE + "SELECT user_id, day, attempt, error FROM latest",
    "attempt_routing": _ROUTE + (
        "SELECT user_id, day, attempt, error, CASE WHEN error = '' THEN 'review' WHEN attempt >= 3 THEN 'escalate' "
        "ELSE 'retry' END AS route FROM latest"),
    "run_listing": with_(RUNS) + (
        "SELECT run_id, started_at, status, target_table FROM runs ORDER BY started_at DESC, run_id"),
    "run_documents": with_(RUNS) + """
SELECT run_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CAST(json_object(
  'id', run_id, 'targetTable', target_table, 'status', status, 'mappingsValidated', mappings_validated,
  'mappingsExcluded', mappings_excluded, 'costGb', cost_gb, 'costUsd', cost_usd, 'startedAt', started_at,
  'durationSec', duration_sec, 'currentStep', current_step, 'stepFailed', step_failed,
  'attempt', CASE WHEN attempt_current IS NOT NULL AND attempt_max IS NOT NULL
    THEN json_object('step', 3, 'current', attempt_current, 'max', attempt_max) END,
  'feed', feed, 'findings', findings, 'sqlx', sqlx_code, 'sqlxPath', sqlx_path,
  'audit', CASE WHEN audit_rows_written IS NOT NULL THEN json_object('rowsWritten', audit_rows_written,
    'countsMatch', COALESCE(audit_counts_match, false), 'nullsCheck', COALESCE(audit_nulls_check, false),
    'failedCheck', nullif(audit_failed_check, '')) END,
  'meta', json_object('files', file_names, 'llmAttempts', llm_attempts, 'llmPromptTokens', llm_prompt_tokens,
    'llmCompletionTokens', llm_completion_tokens, 'llmCostUsd', llm_cost_usd, 'createdBy', created_by,
    'approvedBy', approved_by, 'workflowId', workflow_id)) AS VARCHAR),
  ',"failedCheck":null', '', 'g'), ',"createdBy":null', '', 'g'), ',"approvedBy":null', '', 'g'),
  ',"workflowId":null', '', 'g') AS doc
FROM runs""",
    "feed_timeline": with_(RUN_FEED) + (
        "SELECT run_id, seq, ts, kind, text, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS position "
        "FROM run_feed"),
    "run_step_states": with_(RUNS) + """
SELECT run_id, CAST(step AS INTEGER) AS step,
  CASE WHEN status = 'succeeded' THEN 'done' WHEN step < current_step THEN 'done'
       WHEN step = current_step AND (step_failed OR status IN ('failed', 'rejected')) THEN 'failed'
       WHEN step = current_step THEN 'active' ELSE 'pending' END AS state
FROM runs, range(0, 8) s(step)""",
    "run_files": with_(RUNS) + (
        "SELECT run_id, CAST(len(file_names) AS INTEGER) AS n_files, array_to_string(file_names, ', ') AS files "
        "FROM runs"),
    "latest_run_state": with_(RUNS) + """
SELECT run_id, field, arg_max(value, seq) AS value, max(seq) AS seq FROM (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, event_type AS field, value, event_id AS seq FROM events) u
WHERE run_id IN (SELECT run_id FROM runs) GROUP BY run_id, field""",
    "format_duration": with_(RUNS) + f"SELECT run_id, duration_sec, {_fmt_duration('duration_sec')} AS duration FROM runs",
    "time_ago": with_(RUNS) + f"""
SELECT run_id, started_at,
  CASE WHEN {_S} < 60 THEN CAST({_S} AS VARCHAR) || 's ago'
       WHEN {_M} < 60 THEN CAST({_M} AS VARCHAR) || 'm ago'
       WHEN {_H} < 24 THEN CAST({_H} AS VARCHAR) || 'h ago'
       ELSE CAST({_D} AS VARCHAR) || 'd ago' END AS ago
FROM runs""",
}

_FACT_TARGET = ("fact_target AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' "
                "AND event_id % 50 <> 0)")

ORACLE_STREAM = {
    "fact_incremental_stream": with_(_FACT_TARGET) + (
        "SELECT * FROM fact_target UNION ALL "
        "SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM fact_target) - INTERVAL 2 DAY "
        "AND event_id NOT IN (SELECT event_id FROM fact_target)"),
    "feed_append_stream": with_(RUN_FEED) + "SELECT run_id, seq, ts, kind, text FROM run_feed",
    "latest_run_state_stream": ORACLE_HISTORY["latest_run_state"],
    "attempt_routing_stream": _ROUTE + """, last AS (
  SELECT user_id, CAST(ts AS DATE) AS day, epoch_ms(max(ts)) AS ms FROM events GROUP BY 1, 2)
SELECT user_id, day, attempt, error, CASE WHEN error = '' THEN 'review' WHEN attempt >= 3 THEN 'escalate'
  WHEN ms + 3 * 86400000 < (SELECT epoch_ms(max(ts)) - 86400000 FROM events) THEN 'failed' ELSE 'retry' END AS route
FROM latest JOIN last USING (user_id, day)""",
}
