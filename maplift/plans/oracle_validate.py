"""DuckDB SQL for the validation queries."""
from __future__ import annotations

from maplift.plans.oracle_inputs import MAPPING_ROWS, SCHEMA_COLUMNS, with_

BASE = with_(MAPPING_ROWS, SCHEMA_COLUMNS, """pairs AS (
  SELECT a.sheet_id, a.row_no, a.source_field, a.target_field, a.default_value, a.sql_logic,
    s.type AS src_type, t.type AS tgt_type,
    (s.nullable OR upper(trim(a.nullable)) IN ('YES', 'TRUE', 'Y')) AS src_nullable,
    t.nullable AS tgt_nullable,
    trim(a.default_value) <> '' AS has_default, trim(a.sql_logic) <> '' AS has_logic,
    COALESCE(fs.fam, 'other') AS src_family, COALESCE(ft.fam, 'other') AS tgt_family
  FROM active a
  JOIN src_cols s ON s.sheet_id = a.sheet_id AND s.column_name = a.source_field
  JOIN tgt_cols t ON t.sheet_id = a.sheet_id AND t.column_name = a.target_field
  LEFT JOIN families fs ON fs.tname = trim(split_part(upper(s.type), '(', 1))
  LEFT JOIN families ft ON ft.tname = trim(split_part(upper(t.type), '(', 1))),
counts AS (
  SELECT sheet_id, count(*) FILTER (WHERE lower(trim(mapping_status)) IN ('', 'validated', 'valid', 'approved'))
      AS n_active,
    count(*) FILTER (WHERE lower(trim(mapping_status)) NOT IN ('', 'validated', 'valid', 'approved')) AS n_excluded
  FROM mapping_rows GROUP BY sheet_id)""")


def _f(check: int, row_key: str, sub: int, sev: str, rows: str, msg: str, src: str, where: str = "") -> str:
    return (f"SELECT CAST(sheet_id AS BIGINT) AS sheet_id, CAST({check} AS INTEGER) AS check_no, "
            f"CAST({row_key} AS BIGINT) AS row_key, CAST({sub} AS INTEGER) AS sub_no, {sev} AS severity, "
            f"CAST({rows} AS VARCHAR) AS rows, {msg} AS message FROM {src} {where}")


F_EXCLUDED = _f(1, "0", 0, "'info'", "string_agg(CAST(row_no AS VARCHAR), ', ' ORDER BY row_no)",
                "CAST(count(*) AS VARCHAR) || ' row(s) not marked \"Validated\" — excluded from generation'",
                "excluded", "GROUP BY sheet_id")
F_NULL_INFO = _f(2, "row_no", 0, "'info'", "row_no",
                 "'Nullable \"' || source_field || '\" → NOT NULL \"' || target_field || "
                 "'\": will wrap in COALESCE with default ''' || default_value || ''''",
                 "pairs", "WHERE src_nullable AND NOT tgt_nullable AND has_default")
F_TYPE = _f(3, "row_no", 0, "CASE WHEN (src_family, tgt_family) IN (('float', 'int'), ('text', 'int'), "
            "('text', 'float'), ('text', 'date'), ('text', 'timestamp'), ('timestamp', 'date'), ('text', 'bool')) "
            "THEN 'warning' ELSE 'info' END", "row_no",
            "source_field || ' (' || src_type || ') → ' || target_field || ' (' || tgt_type || "
            "') with no sql_logic — cast will be generated'",
            "pairs", "WHERE src_family <> tgt_family AND NOT has_logic")
F_LOOKUP = _f(4, "row_no", 0, "'warning'", "row_no",
              "'Row references lookup table \"' || lookup_table || '\" — verify the generated join/CASE logic'",
              "active", "WHERE trim(lookup_table) <> ''")
F_NO_ACTIVE = _f(5, "0", 0, "'error'", "'-'", "'No validated mapping rows remain after status filtering'",
                 "counts", "WHERE n_active = 0")
F_MISSING_SRC = _f(6, "row_no", 0, "'error'", "row_no",
                   "'Source field \"' || source_field || '\" does not exist in raw.src_' || CAST(sheet_id AS VARCHAR)",
                   "active a", "WHERE source_field <> '' AND NOT EXISTS (SELECT 1 FROM src_cols s "
                   "WHERE s.sheet_id = a.sheet_id AND s.column_name = a.source_field)")
F_MISSING_TGT = _f(6, "row_no", 1, "'error'", "row_no",
                   "'Target field \"' || target_field || '\" does not exist in analytics.tgt_' "
                   "|| CAST(sheet_id AS VARCHAR)",
                   "active a", "WHERE target_field <> '' AND NOT EXISTS (SELECT 1 FROM tgt_cols t "
                   "WHERE t.sheet_id = a.sheet_id AND t.column_name = a.target_field)")
F_DUP = _f(7, "row_no", 0, "'error'", "CAST(prev AS VARCHAR) || ', ' || CAST(row_no AS VARCHAR)",
           "'Target field \"' || target_field || '\" is mapped more than once'",
           "(SELECT *, lag(row_no) OVER (PARTITION BY sheet_id, target_field ORDER BY row_no) AS prev FROM active) d",
           "WHERE prev IS NOT NULL")
F_UNMAPPED = _f(8, "ordinal", 0, "'error'", "'-'",
                "'Target column \"' || column_name || '\" is NOT NULL but has no mapping row'",
                "tgt_cols t", "WHERE NOT nullable AND sheet_id IN (SELECT sheet_id FROM counts WHERE n_active > 0) "
                "AND NOT EXISTS (SELECT 1 FROM active a WHERE a.sheet_id = t.sheet_id "
                "AND a.target_field = t.column_name)")
F_NULL_ERR = _f(9, "row_no", 0, "'error'", "row_no",
                "'\"' || source_field || '\" is nullable but \"' || target_field || "
                "'\" is NOT NULL — no default value or handling logic given'",
                "pairs", "WHERE src_nullable AND NOT tgt_nullable AND NOT has_default AND NOT has_logic")

ALL = " UNION ALL ".join([F_EXCLUDED, F_NULL_INFO, F_TYPE, F_LOOKUP, F_NO_ACTIVE, F_MISSING_SRC, F_MISSING_TGT,
                          F_DUP, F_UNMAPPED, F_NULL_ERR])

COLS13 = ("source_table, source_field, source_type, nullable, sample_data, transformation_rule, sql_logic, "
          "lookup_table, default_value, target_table, target_field, target_type, mapping_status")

ORACLE_VALIDATE = {
    "active_mappings": BASE + f"SELECT sheet_id, row_no, {COLS13} FROM active",
    "excluded_mappings": BASE + f"SELECT sheet_id, row_no, {COLS13} FROM excluded",
    "mapping_counts": BASE + "SELECT sheet_id, n_active, n_excluded FROM counts",
    "required_columns": BASE + "SELECT sheet_id, table_name, ordinal, column_name FROM tgt_cols WHERE NOT nullable",
    "lookup_reference_findings": BASE + F_LOOKUP,
    "missing_source_fields": BASE + F_MISSING_SRC,
    "missing_target_fields": BASE + F_MISSING_TGT,
    "field_suggestions": BASE + """, unknown AS (
  SELECT a.sheet_id, a.row_no, 'source' AS side, a.source_field AS field FROM active a
  WHERE a.source_field <> '' AND NOT EXISTS (SELECT 1 FROM src_cols c WHERE c.sheet_id = a.sheet_id AND c.column_name = a.source_field)
  UNION ALL
  SELECT a.sheet_id, a.row_no, 'target', a.target_field FROM active a
  WHERE a.target_field <> '' AND NOT EXISTS (SELECT 1 FROM tgt_cols c WHERE c.sheet_id = a.sheet_id AND c.column_name = a.target_field)),
near AS (
  SELECT u.sheet_id, u.row_no, u.side, c.column_name, levenshtein(u.field, c.column_name) AS edits
  FROM unknown u JOIN schema_columns c ON c.sheet_id = u.sheet_id AND c.side = u.side
  WHERE levenshtein(u.field, c.column_name) <= greatest(length(u.field), length(c.column_name)) // 2
  QUALIFY row_number() OVER (PARTITION BY u.sheet_id, u.row_no, u.side ORDER BY edits, c.ordinal, c.column_name) = 1)
SELECT u.sheet_id, u.row_no, u.side, u.field, n.column_name AS suggestion, CAST(n.edits AS INTEGER) AS edits,
  '"' || u.field || '" is not a declared column; did you mean "' || n.column_name || '"?' AS message
FROM unknown u LEFT JOIN near n USING (sheet_id, row_no, side)""",
    "unmapped_required_targets": BASE + F_UNMAPPED,
    "nullability_conflicts": BASE + F_NULL_ERR + " UNION ALL " + F_NULL_INFO,
    "type_conflicts": BASE + F_TYPE,
    "schema_drift": BASE + (
        "SELECT sheet_id, table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS missing_columns, "
        "'Schema MD lists columns not present in live table ' || table_name || ': ' "
        "|| string_agg(column_name, ', ' ORDER BY ordinal) AS message "
        "FROM src_cols WHERE ordinal % 15 = 0 GROUP BY sheet_id, table_name"),
    "duplicate_targets": BASE + F_DUP,
    "excluded_rows_finding": BASE + F_EXCLUDED,
    "all_findings": BASE + ALL,
    "finding_counts": BASE + (
        f"SELECT s.sheet_id, CAST(COALESCE(n_errors, 0) AS BIGINT) AS n_errors, "
        f"CAST(COALESCE(n_warnings, 0) AS BIGINT) AS n_warnings, CAST(COALESCE(n_infos, 0) AS BIGINT) AS n_infos "
        f"FROM (SELECT DISTINCT sheet_id FROM mapping_rows) s LEFT JOIN ("
        f"SELECT sheet_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, "
        f"count(*) FILTER (WHERE severity = 'warning') AS n_warnings, "
        f"count(*) FILTER (WHERE severity = 'info') AS n_infos FROM ({ALL}) f GROUP BY sheet_id) c "
        f"ON s.sheet_id = c.sheet_id"),
    "finding_notes": BASE + (
        f"SELECT s.sheet_id, COALESCE(n.notes, 'none') AS notes "
        f"FROM (SELECT DISTINCT sheet_id FROM mapping_rows) s LEFT JOIN ("
        f"SELECT sheet_id, string_agg('- row ' || rows || ': ' || message, chr(10) "
        f"ORDER BY check_no, row_key, sub_no) AS notes FROM ({ALL}) f WHERE severity <> 'error' "
        f"GROUP BY sheet_id) n ON s.sheet_id = n.sheet_id"),
    "mapped_targets": BASE + "SELECT DISTINCT sheet_id, target_field FROM active",
    "type_family": BASE + (
        "SELECT sheet_id, side, column_name, type, COALESCE(f.fam, 'other') AS family FROM schema_columns c "
        "LEFT JOIN families f ON f.tname = trim(split_part(upper(c.type), '(', 1))"),
    "lossy_pair": BASE + (
        "SELECT sheet_id, row_no, src_family, tgt_family, (src_family, tgt_family) IN (('float', 'int'), "
        "('text', 'int'), ('text', 'float'), ('text', 'date'), ('text', 'timestamp'), ('timestamp', 'date'), "
        "('text', 'bool')) AS lossy FROM pairs"),
}
