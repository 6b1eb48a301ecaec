"""DuckDB SQL for each query key (the correctness oracle)."""
from __future__ import annotations

from maplift.plans.oracle_inputs import (ATTEMPTS, AUDIT_TARGET, MAPPED, MAPPING_ROWS, PATIENTS, RUN_FEED, RUNS,
                                         SCHEMA_COLUMNS, with_)

ORACLE: dict[str, str] = {}


def _rule(expr: str) -> str:
    return with_(PATIENTS) + f"SELECT patient_id, {expr} AS value FROM patients"


ORACLE["apply_mapping"] = with_(PATIENTS, MAPPED) + (
    "SELECT patient_id, full_name, email_address, date_of_birth, weight, site_city, is_enrolled, _loaded_at "
    "FROM mapped")
ORACLE["rule_copy"] = _rule("primary_provider_id")
ORACLE["rule_concat_space"] = _rule("concat(first_name, ' ', last_name)")
ORACLE["rule_clean_email"] = _rule("trim(lower(cust_email_01))")
ORACLE["rule_iso_date"] = _rule("CAST(dob AS DATE)")
ORACLE["rule_round_int"] = _rule("CAST(round_even(weight_kg, 0) AS INTEGER)")
ORACLE["rule_code_case"] = _rule(
    "CASE site_code WHEN '01' THEN 'Chennai' WHEN '02' THEN 'Mumbai' WHEN '03' THEN 'Delhi' ELSE 'Unknown' END")
ORACLE["rule_flag_bool"] = _rule("(enrolled_flag = 'Y')")
ORACLE["rule_load_time"] = _rule("TIMESTAMP '2026-06-10 00:00:00'")
ORACLE["rule_default"] = _rule("COALESCE(primary_provider_id, 'PR-UNASSIGNED')")
ORACLE["rule_type_cast"] = _rule("CAST(round_even(weight_kg, 0) AS INTEGER)")
ORACLE["rule_safe_cast"] = _rule("TRY_CAST(risk_score AS INTEGER)")
ORACLE["rule_title_case"] = _rule(
    "array_to_string(list_transform(string_split(lower(trim(raw_note)), ' '), "
    "lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")
ORACLE["rule_unit_convert"] = _rule("round(height_cm / 2.54, 1)")
ORACLE["rule_parse_date_fmt"] = _rule("CAST(strptime(dob, '%Y-%m-%d') AS DATE)")
ORACLE["rule_utc_timestamp"] = _rule("admitted_at")
ORACLE["rule_clean_string"] = _rule("nullif(trim(regexp_replace(raw_note, '\\s+', ' ', 'g')), '')")
ORACLE["lookup_join"] = with_(PATIENTS) + (
    "SELECT p.patient_id, p.nation_key, COALESCE(l.name, 'Unknown') AS nation_name FROM patients p "
    "LEFT JOIN (SELECT n_nationkey AS code, min(n_name) AS name FROM nation WHERE n_nationkey % 5 <> 0 "
    "GROUP BY n_nationkey) l ON p.nation_key = l.code")
ORACLE["row_filter"] = with_(PATIENTS, MAPPED) + (
    "SELECT patient_id, full_name, email_address, date_of_birth, weight, site_city, is_enrolled, _loaded_at "
    "FROM mapped WHERE record_status = 'ACTIVE'")
ORACLE["target_preview"] = with_(PATIENTS, MAPPED) + (
    "SELECT patient_id, full_name, email_address, date_of_birth, weight, site_city, is_enrolled "
    "FROM mapped ORDER BY patient_id LIMIT 10")

_TITLE = ("array_to_string(list_transform(string_split(lower(trim(raw_note)), ' '), "
          "lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')")
ORACLE["apply_mapping_rules"] = with_(PATIENTS) + f"""
SELECT patient_id, primary_provider_id AS r_copy, concat(first_name, ' ', last_name) AS r_concat,
  trim(lower(cust_email_01)) AS r_email, CAST(dob AS DATE) AS r_date, CAST(round_even(weight_kg, 0) AS INTEGER) AS r_round,
  CASE site_code WHEN '01' THEN 'Chennai' WHEN '02' THEN 'Mumbai' WHEN '03' THEN 'Delhi' ELSE 'Unknown' END AS r_site,
  CASE site_code WHEN '01' THEN 'one' WHEN '02' THEN 'it''s two' ELSE 'more' END AS r_case,
  enrolled_flag = 'N' AS r_flag, TIMESTAMP '2026-06-10 00:00:00' AS r_time,
  COALESCE(primary_provider_id, 'PR-NONE') AS r_default, CAST(round_even(weight_kg, 0) AS INTEGER) AS r_cast,
  TRY_CAST(risk_score AS INTEGER) AS r_safe, {_TITLE} AS r_title, round(height_cm / 2.54, 1) AS r_unit,
  CAST(strptime(dob, '%Y-%m-%d') AS DATE) AS r_parsed, admitted_at AS r_utc,
  nullif(trim(regexp_replace(raw_note, '\\s+', ' ', 'g')), '') AS r_clean,
  round_even(COALESCE(weight_kg, 0), 0) AS s_round, CAST(round_even(weight_kg, 0) AS INTEGER) AS s_cast,
  CAST(round(CAST(weight_kg AS DECIMAL(10, 2))) AS INTEGER) AS s_numeric, concat('round(select)', site_code, NULL) AS s_concat,
  TIMESTAMP '2026-06-10 00:00:00' AS s_time
FROM patients"""
