"""DuckDB SQL for the text queries (documents, sheets, model files)."""
from __future__ import annotations

from maplift.plans.oracle_inputs import MAPPING_ROWS, RUNS, SCHEMA_COLUMNS, with_
from maplift.sources.derived import CONVENTIONS_DOCS
from maplift.sources.model_files import BARE_REF, DOTTED_REF, FENCED, JS_BLOCK, PY_WS, SELECT_TAIL
from maplift.sources.tables import REF_PATTERN


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CONFIG = ('config {\n  type: "table",\n  schema: "analytics",\n  tags: ["daily"],\n'
           '  assertions: { nonNull: ["id"], rowConditions: { ok: ["id > 0"] } },\n  labels: ')
_NESTED = f"""{lit(_CONFIG)} || repeat('{{ a: ', CAST(p_partkey % 12 + 1 AS INTEGER)) || {lit("'select'")}
      || repeat(' }}', CAST(p_partkey % 12 + 1 AS INTEGER)) || {lit(chr(10) + "}" + chr(10))}"""

MODEL_FILES = f"""model_files AS (
  SELECT 'models/m' || CAST(p_partkey AS VARCHAR) AS path,
    CASE WHEN p_partkey % 40 = 0 THEN {_NESTED} || {lit("-- nothing generated" + chr(10))}
    ELSE {_NESTED} || {lit("js { const src = 'x'; }" + chr(10))}
      || CASE WHEN p_partkey % 13 = 0 THEN {lit("-- select the rows of t" + chr(10))} ELSE '' END
      || CASE WHEN p_partkey % 17 = 0 THEN {lit("WITH src AS (SELECT 1 AS id)" + chr(10))} ELSE '' END
      || {lit('SELECT' + chr(10) + '  p.id AS "id",' + chr(10) + "  '")} || p_brand
      || {lit("' AS brand" + chr(10) + 'FROM ${ref("t')} || CAST(p_size AS VARCHAR) || {lit('")} p')}
      || CASE WHEN p_partkey % 3 = 0 THEN {lit(chr(10) + 'JOIN ${ ref("staging.dim_')}
           || CAST(p_partkey % 7 AS VARCHAR) || {lit('") } d ON d.id = p.id')} ELSE '' END
      || {lit(";" + chr(10))}
      || CASE WHEN p_partkey % 19 = 0 THEN {lit("post_operations {" + chr(10) + "  GRANT SELECT ON ${self()} TO reader"
                                                 + chr(10) + "}" + chr(10))} ELSE '' END END AS text
  FROM part)"""

_WS_TRIM = rx(f"^{PY_WS}+|{PY_WS}+$")

_SHEET_ROWS = with_(MAPPING_ROWS, """sheet AS (
  SELECT sheet_id, row_no, source_table, source_field, source_type, nullable,
    CASE WHEN row_no % 8 = 0 THEN '' WHEN row_no % 9 = 0 THEN 'two' || chr(10) || 'lines' ELSE sample_data END
      AS sample_data,
    transformation_rule, sql_logic, lookup_table, default_value, target_table, target_field, target_type,
    trim(mapping_status) AS mapping_status
  FROM mapping_rows),
blank AS (
  SELECT sheet_id, max(row_no) + 1 AS row_no, '' AS source_table, '' AS source_field, '' AS source_type,
    '' AS nullable, '' AS sample_data, '' AS transformation_rule, '' AS sql_logic, '' AS lookup_table,
    '' AS default_value, '' AS target_table, '' AS target_field, '' AS target_type, '' AS mapping_status
  FROM mapping_rows GROUP BY sheet_id)""")

_COLS = ("sheet_id, row_no, source_table, source_field, source_type, nullable, sample_data, transformation_rule, "
         "sql_logic, lookup_table, default_value, target_table, target_field, target_type, mapping_status")

# the block ends where the running count of braces, one character at a time, first returns to zero
_BODY = with_(MODEL_FILES, f"""s0 AS (SELECT path, text, length(regexp_extract(text, '(?s)^(.*?config\\s*)\\{{', 1)) AS p0 FROM model_files),
ch AS (SELECT path, i, sum(CASE substr(text, i, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)
         OVER (PARTITION BY path ORDER BY i) AS depth
       FROM s0, unnest(range(p0 + 1, length(text) + 1)) r(i) WHERE regexp_matches(text, 'config\\s*\\{{')),
ends AS (SELECT path, min(i) AS e FROM ch WHERE depth = 0 GROUP BY path),
s1 AS (SELECT s0.path, regexp_replace(CASE WHEN e IS NULL THEN text
         ELSE regexp_replace(left(text, p0), '(?s)config\\s*$', '') || substr(text, e + 1) END, {_WS_TRIM}, '', 'g') AS t
       FROM s0 LEFT JOIN ends ON s0.path = ends.path),
s2 AS (SELECT path, regexp_replace(t, {rx(JS_BLOCK)}, '', 'g') AS t FROM s1),
s3 AS (SELECT path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {rx(DOTTED_REF)}, '\\1', 'g'),
    {rx(BARE_REF)}, 'raw.\\1', 'g'), {_WS_TRIM}, '', 'g'), ';+$', '') AS t FROM s2)""")

ORACLE_TEXT = {
    "schema_doc_scan": with_(MAPPING_ROWS, SCHEMA_COLUMNS) + """
SELECT CAST(sheet_id AS VARCHAR) || ':' || side AS doc_id, table_name, ordinal, column_name,
  CASE WHEN ordinal = 1 THEN 'TEXT' ELSE type END AS type,
  CASE WHEN ordinal = 1 THEN true ELSE nullable END AS nullable,
  CASE WHEN ordinal = 1 THEN 'repeated' ELSE description END AS description
FROM schema_columns""",
    "schema_doc_rejects": with_(MAPPING_ROWS) + """
SELECT CAST(sheet_id AS VARCHAR) || ':noheading' AS doc_id,
  'Schema MD must start with a line like ''# Table: raw.clinical_patients''' AS error
FROM (SELECT DISTINCT sheet_id FROM mapping_rows)
UNION ALL
SELECT CAST(sheet_id AS VARCHAR) || ':norows',
  'No column rows found in schema MD for table raw.empty_' || CAST(sheet_id AS VARCHAR)
FROM (SELECT DISTINCT sheet_id FROM mapping_rows)""",
    "mapping_sheet_scan": _SHEET_ROWS + f"SELECT {_COLS} FROM sheet",
    "sheet_row_numbers": _SHEET_ROWS + (
        "SELECT sheet_id, row_no, source_field, target_field FROM sheet "
        "UNION ALL SELECT sheet_id, row_no, source_field, target_field FROM blank"),
    "canonical_sheet_export": _SHEET_ROWS + f"SELECT {_COLS} FROM sheet UNION ALL SELECT {_COLS} FROM blank",
    "normalize_headers": (
        "SELECT p_partkey, p_type AS header, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', "
        "'g'), '^_+|_+$', '', 'g') AS normalized FROM part"),
    "ref_scan": "SELECT * FROM orders",
    "model_bodies": _BODY + f"""
SELECT path, body, error,
  CASE WHEN body IS NULL THEN NULL ELSE concat_ws(',',
    CASE WHEN regexp_matches(t, '(?is)^\\s*with\\b') THEN 'with_clause' END,
    CASE WHEN contains(string_split(regexp_extract(t, '(?is)^(.*?)\\bselect\\b', 1), chr(10))[-1], '--')
      THEN 'select_in_comment' END,
    CASE WHEN regexp_matches(body, 'post_operations\\s*\\{{') THEN 'post_operations' END) END AS flag
FROM (SELECT path, t,
  CASE WHEN regexp_matches(t, '(?i)\\bselect\\b') THEN regexp_extract(t, {rx(SELECT_TAIL)}, 1) END AS body,
  CASE WHEN NOT regexp_matches(t, '(?i)\\bselect\\b') THEN 'Generated .sqlx contains no SELECT statement' END AS error
FROM s3)""",
    "model_ref_edges": with_(MODEL_FILES) + f"""
SELECT DISTINCT path, CASE WHEN contains(r, '.') THEN r ELSE 'raw.' || r END AS ref_table
FROM (SELECT path, unnest(regexp_extract_all(text, {rx(REF_PATTERN)}, 1)) AS r FROM model_files)""",
    "fenced_blocks": f"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN {lit("Here is the model:" + chr(10) + "```sqlx" + chr(10))}
  || text || {lit(chr(10) + "```" + chr(10) + "Done.")} ELSE text END AS text FROM conversations)
SELECT conv_id, turn, regexp_replace(CASE WHEN regexp_matches(text, {rx(FENCED)})
  THEN regexp_extract(text, {rx(FENCED)}, 1) ELSE text END, {_WS_TRIM}, '', 'g') AS body FROM c""",
    "model_path": with_(RUNS) + f"""
SELECT run_id, target_table,
  COALESCE(nullif(regexp_extract(conv, '(definitions/[\\w/-]+/)', 1), ''), 'definitions/marts/')
    || string_split(target_table, '.')[-1] || '.sqlx' AS sqlx_path
FROM (SELECT run_id, target_table, [{', '.join(lit(d) for d in CONVENTIONS_DOCS)}][
  CAST(regexp_extract(run_id, '(\\d+)$', 1) AS BIGINT) % 3 + 1] AS conv FROM runs)""",
}
