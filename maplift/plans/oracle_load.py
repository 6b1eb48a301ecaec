"""DuckDB SQL for the load and audit queries."""
from __future__ import annotations

from maplift.plans.oracle_inputs import AUDIT_TARGET, MAPPED, PATIENTS, with_

_NULLS = """n AS (SELECT count(*) FILTER (WHERE o_orderkey IS NULL) AS n1,
  count(*) FILTER (WHERE o_orderpriority IS NULL) AS n2,
  count(*) FILTER (WHERE o_orderstatus IS NULL) AS n3, count(*) AS rows_written FROM audit_target)"""

_FACT_TARGET = ("fact_target AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' "
                "AND event_id % 50 <> 0)")

ORACLE_LOAD = {
    "load_audit": with_(AUDIT_TARGET, _NULLS) + """
SELECT source_rows, rows_written, counts_match, null_violations, bad_col, ok,
  CASE WHEN ok THEN NULL WHEN NOT counts_match THEN 'row counts do not match'
       ELSE 'nulls found in required column "' || bad_col || '"' END AS failed_check
FROM (SELECT *, counts_match AND null_violations = 0 AS ok FROM (
  SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS source_rows, CAST(rows_written AS BIGINT) AS rows_written,
    (SELECT count(*) FROM orders) = rows_written AS counts_match,
    CAST(n1 + n2 + n3 AS BIGINT) AS null_violations,
    CASE WHEN n1 > 0 THEN 'o_orderkey' WHEN n2 > 0 THEN 'o_orderpriority' WHEN n3 > 0 THEN 'o_orderstatus' END
      AS bad_col
  FROM n))""",
    "null_violations": with_(AUDIT_TARGET, _NULLS) + """
SELECT 1 AS ordinal, 'o_orderkey' AS column_name, CAST(n1 AS BIGINT) AS null_count FROM n UNION ALL
SELECT 2, 'o_orderpriority', CAST(n2 AS BIGINT) FROM n UNION ALL
SELECT 3, 'o_orderstatus', CAST(n3 AS BIGINT) FROM n""",
    "null_rows": with_(AUDIT_TARGET) + (
        "SELECT * FROM audit_target WHERE o_orderkey IS NULL OR o_orderpriority IS NULL OR o_orderstatus IS NULL"),
    "volume_estimate": with_(PATIENTS, MAPPED) + """
SELECT est_rows, est_bytes, round(est_bytes / 1e9, 4) AS est_gb FROM (
  SELECT count(*) AS est_rows, CAST(COALESCE(sum(
    COALESCE(strlen(patient_id), 0) + COALESCE(strlen(full_name), 0) + COALESCE(strlen(email_address), 0)
    + CASE WHEN date_of_birth IS NULL THEN 0 ELSE 4 END + CASE WHEN weight IS NULL THEN 0 ELSE 4 END
    + COALESCE(strlen(site_city), 0) + CASE WHEN is_enrolled IS NULL THEN 0 ELSE 1 END
    + CASE WHEN _loaded_at IS NULL THEN 0 ELSE 8 END), 0) AS BIGINT) AS est_bytes
  FROM mapped)""",
    "full_refresh_load": "SELECT * FROM part",
    "append_load": "SELECT * FROM part",
    "row_count": "SELECT count(*) AS row_count FROM part",
    "scd1_upsert": """
WITH tgt AS (SELECT *, CAST(0 AS BIGINT) AS version FROM customer WHERE c_custkey % 10 <> 0),
src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1000 AS c_acctbal, c_mktsegment, CAST(2 AS BIGINT) AS version
  FROM customer WHERE c_custkey % 3 = 0
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 500, c_mktsegment, CAST(1 AS BIGINT)
  FROM customer WHERE c_custkey % 6 = 0),
latest AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC) = 1)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, version FROM tgt
WHERE c_custkey NOT IN (SELECT c_custkey FROM latest)
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, version FROM latest""",
    "shared_source_load": with_(PATIENTS, MAPPED) + """
SELECT 0 AS sheet_id, patient_id, full_name AS value FROM mapped
UNION ALL SELECT 1, patient_id, email_address FROM mapped
UNION ALL SELECT 2, patient_id, CAST(weight AS VARCHAR) FROM mapped""",
    "fact_incremental": with_(_FACT_TARGET) + (
        "SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM fact_target) - INTERVAL 2 DAY "
        "AND event_id NOT IN (SELECT event_id FROM fact_target)"),
    "incremental_filter": with_(_FACT_TARGET) + "SELECT * FROM events WHERE ts > (SELECT max(ts) FROM fact_target)",
    "partition_replace": ("SELECT * REPLACE (CASE WHEN day(ts) % 2 = 0 THEN value * 2 ELSE value END AS value), "
                          "CAST(ts AS DATE) AS dt FROM events"),
    "partitioned_load": "SELECT *, CAST(ts AS DATE) AS dt FROM events",
}
