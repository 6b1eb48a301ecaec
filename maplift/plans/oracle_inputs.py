"""The derived inputs of FIXTURES.md part 3 as DuckDB SQL (common table
expressions), written independently of the Spark derivations so the oracle
checks them too."""
from __future__ import annotations

PATIENTS = """patients AS (
  SELECT 'P-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS patient_id,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'First' || CAST(c_custkey % 100 AS VARCHAR) END AS first_name,
    CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'Last' || CAST(c_custkey % 90 AS VARCHAR) END AS last_name,
    CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE '  ' || upper(c_name) || '@Mail.com ' END AS cust_email_01,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE '19' || CAST(50 + c_custkey % 50 AS VARCHAR) || '-'
         || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-'
         || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS dob,
    CASE WHEN c_custkey % 9 = 0 THEN NULL
         ELSE CAST(c_custkey % 100 AS DOUBLE) + CAST(c_custkey % 4 AS DOUBLE) / 2 END AS weight_kg,
    CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 4 + 1 AS VARCHAR), 2, '0') END AS site_code,
    CASE c_custkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS enrolled_flag,
    TIMESTAMP '2026-06-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS created_at,
    CASE WHEN c_custkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS record_status,
    150 + CAST(c_custkey % 400 AS DOUBLE) / 10 AS height_cm,
    CASE WHEN c_custkey % 23 = 0 THEN 'abc' ELSE CAST(c_custkey % 100 AS VARCHAR) END AS risk_score,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'PR' || CAST(c_custkey % 40 AS VARCHAR) END AS primary_provider_id,
    CASE c_custkey % 4 WHEN 0 THEN '  joHN   smITH ' WHEN 1 THEN '   ' WHEN 3 THEN 'a  b' END AS raw_note,
    TIMESTAMP '2026-06-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE
      - (c_custkey % 72) * INTERVAL '1' HOUR AS admitted_at,
    c_nationkey AS nation_key
  FROM customer)"""

MAPPED = """mapped AS (
  SELECT patient_id,
    concat(first_name, ' ', last_name) AS full_name,
    trim(lower(cust_email_01)) AS email_address,
    CAST(dob AS DATE) AS date_of_birth,
    CAST(round_even(weight_kg, 0) AS INTEGER) AS weight,
    CASE site_code WHEN '01' THEN 'Chennai' WHEN '02' THEN 'Mumbai' WHEN '03' THEN 'Delhi' ELSE 'Unknown' END
      AS site_city,
    (enrolled_flag = 'Y') AS is_enrolled,
    TIMESTAMP '2026-06-10 00:00:00' AS _loaded_at,
    record_status
  FROM patients)"""

MAPPING_ROWS = """mapping_rows AS (
  SELECT p_partkey // 40 AS sheet_id,
    p_partkey % 40 + 2 AS row_no,
    'raw.src_' || CAST(p_partkey // 40 AS VARCHAR) AS source_table,
    's' || CAST(p_size AS VARCHAR) AS source_field,
    '' AS source_type,
    CASE p_partkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE '' END AS nullable,
    'x' || CAST(p_partkey AS VARCHAR) AS sample_data,
    '' AS transformation_rule,
    CASE WHEN p_partkey % 5 = 0 THEN 'LOWER(x)' ELSE '' END AS sql_logic,
    CASE WHEN p_partkey % 11 = 0 THEN 'site_lookup' ELSE '' END AS lookup_table,
    CASE WHEN p_partkey % 4 = 0 THEN 'Unknown' ELSE '' END AS default_value,
    'analytics.tgt_' || CAST(p_partkey // 40 AS VARCHAR) AS target_table,
    't' || CAST(p_size * 3 % 41 AS VARCHAR) AS target_field,
    '' AS target_type,
    CASE p_partkey % 7 WHEN 0 THEN 'In Progress' WHEN 1 THEN '' WHEN 2 THEN ' approved' WHEN 3 THEN 'VALID'
      ELSE 'Validated' END AS mapping_status
  FROM part),
active AS (
  SELECT * FROM mapping_rows
  WHERE lower(trim(mapping_status)) IN ('', 'validated', 'valid', 'approved')),
excluded AS (
  SELECT * FROM mapping_rows
  WHERE lower(trim(mapping_status)) NOT IN ('', 'validated', 'valid', 'approved'))"""

SCHEMA_COLUMNS = """sheets AS (SELECT DISTINCT sheet_id FROM mapping_rows),
schema_columns AS (
  SELECT sheet_id, 'source' AS side, 'raw.src_' || CAST(sheet_id AS VARCHAR) AS table_name,
    CAST(i AS INTEGER) AS ordinal, 's' || CAST(i AS VARCHAR) AS column_name,
    ['VARCHAR', 'FLOAT', 'TIMESTAMP', 'INTEGER', 'NUMERIC(10,2)', 'INT64'][i % 6 + 1] AS type,
    (i % 2 = 1) AS nullable, 'source column ' || CAST(i AS VARCHAR) AS description
  FROM sheets, range(1, 46) r(i)
  UNION ALL
  SELECT sheet_id, 'target', 'analytics.tgt_' || CAST(sheet_id AS VARCHAR),
    CAST(i + 1 AS INTEGER), 't' || CAST(i AS VARCHAR),
    ['VARCHAR', 'INTEGER', 'DATE', 'BOOLEAN', 'DOUBLE'][i % 5 + 1],
    (i % 4 <> 0), 'target column ' || CAST(i AS VARCHAR)
  FROM sheets, range(0, 36) r(i)),
src_cols AS (SELECT * FROM schema_columns WHERE side = 'source'),
tgt_cols AS (SELECT * FROM schema_columns WHERE side = 'target'),
families AS (
  SELECT * FROM (VALUES ('VARCHAR', 'text'), ('TEXT', 'text'), ('STRING', 'text'), ('CHAR', 'text'),
    ('INT', 'int'), ('INTEGER', 'int'), ('BIGINT', 'int'), ('SMALLINT', 'int'),
    ('FLOAT', 'float'), ('FLOAT64', 'float'), ('DOUBLE', 'float'), ('NUMERIC', 'float'), ('DECIMAL', 'float'),
    ('DATE', 'date'), ('TIMESTAMP', 'timestamp'), ('DATETIME', 'timestamp'),
    ('BOOL', 'bool'), ('BOOLEAN', 'bool')) v(tname, fam))"""

RUNS = """runs0 AS (
  SELECT o_orderkey AS k, o_custkey, o_orderdate, o_totalprice,
    CASE WHEN o_orderkey % 10 = 0 THEN 'running' WHEN o_orderkey % 10 = 1 THEN 'awaiting_review'
         WHEN o_orderkey % 10 = 2 THEN 'rejected' WHEN o_orderkey % 10 <= 4 THEN 'failed'
         ELSE 'succeeded' END AS status
  FROM orders),
runs AS (
  SELECT 'run_' || CAST(k AS VARCHAR) AS run_id,
    'analytics.t' || CAST(o_custkey % 100 AS VARCHAR) AS target_table,
    status,
    CAST(CASE WHEN status = 'succeeded' THEN 7 WHEN status IN ('awaiting_review', 'rejected') THEN 4
         ELSE k % 8 END AS INTEGER) AS current_step,
    (status = 'failed') AS step_failed,
    epoch_ms(o_orderdate) AS started_at,
    CAST(CASE WHEN status IN ('running', 'awaiting_review') THEN NULL ELSE k % 1300 END AS BIGINT) AS duration_sec,
    CAST(CASE WHEN k % 6 = 0 THEN k % 3 + 1 END AS INTEGER) AS attempt_current,
    CAST(CASE WHEN k % 6 = 0 THEN 3 END AS INTEGER) AS attempt_max,
    CAST(CASE WHEN status = 'succeeded' THEN floor(o_totalprice) END AS BIGINT) AS audit_rows_written,
    CASE WHEN status = 'succeeded' THEN TRUE END AS audit_counts_match,
    CASE WHEN status = 'succeeded' THEN k % 9 <> 0 END AS audit_nulls_check,
    CASE WHEN status = 'succeeded' AND k % 9 = 0 THEN 'nulls found in required column "_loaded_at"' END
      AS audit_failed_check,
    CASE WHEN k % 4 = 0 THEN NULL ELSE 'user' || CAST(o_custkey % 10 AS VARCHAR) END AS created_by,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 'approver' || CAST(k % 5 AS VARCHAR) END AS approved_by,
    CASE WHEN k % 2 = 0 THEN NULL ELSE 'wf_' || CAST(k AS VARCHAR) END AS workflow_id,
    CAST(k % 40 AS INTEGER) AS mappings_validated,
    CAST(k % 3 AS INTEGER) AS mappings_excluded,
    CAST(k % 1000 AS DOUBLE) / 100 AS cost_gb,
    0.0::DOUBLE AS cost_usd,
    CASE WHEN k % 2 = 0 THEN ['source_schema.md', 'target_schema.md', 'sttm.csv', 'repo_structure.md',
      'udf_definitions.md'] ELSE ['source_schema.md', 'target_schema.md', 'sttm.csv', 'repo_structure.md'] END
      AS file_names,
    CAST(k % 3 + 1 AS INTEGER) AS llm_attempts,
    k % 5000 AS llm_prompt_tokens,
    k % 900 AS llm_completion_tokens,
    CAST(k % 100 AS DOUBLE) / 100 AS llm_cost_usd,
    CASE WHEN k % 5 <> 0 THEN list_transform(range(0, k % 4), lambda i: json_object('id', 'f' || CAST(i AS VARCHAR),
      'ts', epoch_ms(o_orderdate) + 1000 * i, 'kind', ['thought', 'tool_call', 'tool_result'][i + 1],
      'text', 'step ' || CAST(i AS VARCHAR) || ' of "' || CAST(k AS VARCHAR) || '"')) ELSE [] END AS feed,
    CASE WHEN k % 5 <> 0 THEN list_transform(range(0, k % 3), lambda i: json_object('id', 'v' || CAST(i AS VARCHAR),
      'severity', ['info', 'warning'][i + 1], 'rows', CAST(k % 40 + i AS VARCHAR),
      'message', 'finding ' || CAST(i AS VARCHAR))) ELSE [] END AS findings,
    CASE WHEN k % 4 <> 0 THEN 'SELECT' || chr(10) || '  ' || CAST(k AS VARCHAR) || ' AS "id"' || chr(10) ELSE '' END AS sqlx_code,
    CASE WHEN k % 4 <> 0 THEN 'definitions/marts/t' || CAST(o_custkey % 100 AS VARCHAR) || '.sqlx' ELSE '' END AS sqlx_path
  FROM runs0)"""

RUN_FEED = """run_feed AS (
  SELECT user_id AS run_id, event_id AS seq, ts,
    ['thought', 'tool_call', 'tool_result', 'tool_error'][event_id % 4 + 1] AS kind,
    event_type AS text
  FROM events)"""

ATTEMPTS = """attempts AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_id AS seq,
    CASE WHEN event_type = 'error' THEN event_type ELSE '' END AS error,
    event_id % 5000 AS prompt_units, event_id % 900 AS completion_units,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS attempt
  FROM events)"""

AUDIT_TARGET = """audit_target AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 500 <> 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
