"""Run history: hand-made runs with the figures and documents that belong to them."""
import json

from pyspark.sql import functions as F

from maplift.operators.history import attempt_routing, run_documents, run_kpis, run_step_states

SCHEMA = ("run_id string, target_table string, status string, current_step int, step_failed boolean, "
          "started_at bigint, duration_sec bigint, attempt_current int, attempt_max int, "
          "audit_rows_written bigint, audit_counts_match boolean, audit_nulls_check boolean, "
          "audit_failed_check string, created_by string, approved_by string, workflow_id string, "
          "mappings_validated int, mappings_excluded int, cost_gb double, cost_usd double, "
          "file_names array<string>, llm_attempts int, llm_prompt_tokens bigint, llm_completion_tokens bigint, llm_cost_usd double, "
          "feed array<struct<id:string,ts:bigint,kind:string,text:string>>, "
          "findings array<struct<id:string,severity:string,rows:string,message:string>>, sqlx_code string, sqlx_path string")
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.replace("struct<", "(").replace(", ", ",|").split(",|")]


def runs(spark, *given):
    return spark.createDataFrame([tuple(g.get(n) for n in NAMES) for g in given], SCHEMA)


def test_document_of_a_bare_run(spark):
    doc = json.loads(run_documents(runs(spark, {"run_id": "r", "status": "running"})).first().doc)
    assert doc == {
        "id": "r", "targetTable": "", "status": "running", "mappingsValidated": 0, "mappingsExcluded": 0, "costGb": None, "costUsd": None,
        "startedAt": 0, "durationSec": None, "currentStep": 0, "stepFailed": False, "attempt": None, "feed": [], "findings": [],
        "sqlx": "", "sqlxPath": "", "audit": None,
        "meta": {"files": [], "llmAttempts": 0, "llmPromptTokens": 0, "llmCompletionTokens": 0, "llmCostUsd": 0.0}}


def test_document_of_a_full_run(spark):
    full = {"run_id": "r7", "target_table": "analytics.t", "status": "failed", "current_step": 7, "step_failed": True, "started_at": 12,
            "duration_sec": 3, "attempt_current": 2, "attempt_max": 3, "audit_rows_written": 5, "audit_counts_match": True,
            "audit_failed_check": "nulls", "created_by": "ann", "approved_by": "", "workflow_id": "wf", "mappings_validated": 4,
            "mappings_excluded": 1, "cost_gb": 0.5, "cost_usd": 0.25, "file_names": ["a.md"], "llm_attempts": 2, "llm_prompt_tokens": 10,
            "llm_completion_tokens": 20, "llm_cost_usd": 0.5, "feed": [("f0", 13, "thought", 'say "x"\n')],
            "findings": [("v0", "warning", "4", "m")], "sqlx_code": "SELECT 1\n", "sqlx_path": "definitions/t.sqlx"}
    doc = json.loads(run_documents(runs(spark, full)).first().doc)
    assert doc["attempt"] == {"step": 3, "current": 2, "max": 3}
    assert doc["audit"] == {"rowsWritten": 5, "countsMatch": True, "nullsCheck": False, "failedCheck": "nulls"}
    assert doc["feed"] == [{"id": "f0", "ts": 13, "kind": "thought", "text": 'say "x"\n'}]
    assert doc["findings"] == [{"id": "v0", "severity": "warning", "rows": "4", "message": "m"}]
    assert (doc["sqlx"], doc["sqlxPath"]) == ("SELECT 1\n", "definitions/t.sqlx")
    assert doc["meta"] == {"files": ["a.md"], "llmAttempts": 2, "llmPromptTokens": 10, "llmCompletionTokens": 20, "llmCostUsd": 0.5,
                           "createdBy": "ann", "workflowId": "wf"}
    half = dict(full, attempt_max=None, audit_rows_written=None)
    doc = json.loads(run_documents(runs(spark, half)).first().doc)
    assert doc["attempt"] is None and doc["audit"] is None


def test_kpis(spark):
    some = runs(spark, {"run_id": "a", "status": "succeeded", "duration_sec": 100}, {"run_id": "b", "status": "succeeded", "duration_sec": 41},
                {"run_id": "c", "status": "failed", "duration_sec": 0}, {"run_id": "d", "status": "awaiting_review"},
                {"run_id": "e", "status": "rejected"})
    k = run_kpis(some).first()
    assert (k.total_runs, k.awaiting_review, k.success_rate, k.avg_duration_sec, k.avg_duration) == (5, 1, 67, 47, "47s")
    k = run_kpis(some.where("run_id = 'd'")).first()
    assert (k.success_rate, k.avg_duration) == (0, "—")


def test_step_states(spark):
    given = {("succeeded", 7, False): "dddddddd", ("running", 2, False): "ddappppp", ("failed", 3, True): "dddfpppp",
             ("rejected", 4, False): "ddddfppp", ("awaiting_review", 4, False): "ddddappp", ("running", 0, True): "fppppppp"}
    df = runs(spark, *({"run_id": str(i), "status": s, "current_step": c, "step_failed": f} for i, (s, c, f) in enumerate(given)))
    got = {}
    for r in run_step_states(df).orderBy("run_id", "step").collect():
        got[r.run_id] = got.get(r.run_id, "") + r.state[0]
    assert [got[str(i)] for i in range(len(given))] == list(given.values())


def test_routes(spark):
    cases = [(1, "", "review"), (5, "", "review"), (1, "boom", "retry"), (2, "boom", "retry"), (3, "boom", "escalate"), (4, "x", "escalate")]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "run int, attempt bigint, error string")
    assert [r.route for r in attempt_routing(df).orderBy(F.col("run")).collect()] == [c[2] for c in cases]
