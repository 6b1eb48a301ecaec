"""Data model: table shapes and the fixed values the checks depend on."""
from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the mapping tool's own rules for equal results).
# ---------------------------------------------------------------------------

# The 13 canonical mapping-sheet columns, in sheet order.
MAPPING_COLUMNS = [
    "source_table", "source_field", "source_type", "nullable", "sample_data",
    "transformation_rule", "sql_logic", "lookup_table", "default_value",
    "target_table", "target_field", "target_type", "mapping_status",
]
# Columns a sheet must have after header normalisation.
REQUIRED_SHEET_COLUMNS = ["source_field", "target_field", "target_table"]

# Status values (lower-cased, trimmed) that make a mapping row active.
ACTIVE_STATUSES = ["", "validated", "valid", "approved"]

# Sheet `nullable` values that mark a source as nullable.
SHEET_NULLABLE_VALUES = ["YES", "TRUE", "Y"]
# Schema-document `nullable` values that mark a column as nullable.
DOC_NULLABLE_VALUES = ["YES", "TRUE", "Y", "NULLABLE"]

# Type name -> family.  Anything else is "other".
TYPE_FAMILY = {
    "VARCHAR": "text", "TEXT": "text", "STRING": "text", "CHAR": "text",
    "INT": "int", "INTEGER": "int", "BIGINT": "int", "SMALLINT": "int",
    "FLOAT": "float", "FLOAT64": "float", "DOUBLE": "float", "NUMERIC": "float", "DECIMAL": "float",
    "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp",
    "BOOL": "bool", "BOOLEAN": "bool",
}

# (source family, target family) pairs that lose information.
LOSSY_PAIRS = [
    ("float", "int"), ("text", "int"), ("text", "float"), ("text", "date"),
    ("text", "timestamp"), ("timestamp", "date"), ("text", "bool"),
]

# Cells a pandas CSV reader turns into missing values (then '').
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Default schema for `${ref("t")}` names without a dot.
DEFAULT_SOURCE_SCHEMA = "raw"
DEFAULT_TARGET_SCHEMA = "analytics"
DEFAULT_MODEL_FOLDER = "definitions/marts/"
MODEL_EXTENSION = ".sqlx"

# Generation attempts before a run is escalated.
MAX_ATTEMPTS = 3
# LLM prices in USD per 1M units (input, output).
PRICE_IN_PER_M = 0.59
PRICE_OUT_PER_M = 0.79

# Run workflow steps (index 0..7).
STEP_COUNT = 8

# Finding messages (the `{}` are filled per row).
MSG_EXCLUDED = '{} row(s) not marked "Validated" — excluded from generation'
MSG_NO_ACTIVE = "No validated mapping rows remain after status filtering"
MSG_MISSING_SOURCE = 'Source field "{}" does not exist in {}'
MSG_MISSING_TARGET = 'Target field "{}" does not exist in {}'
MSG_SUGGEST = '"{}" is not a declared column; did you mean "{}"?'
MSG_DUPLICATE = 'Target field "{}" is mapped more than once'
MSG_UNMAPPED = 'Target column "{}" is NOT NULL but has no mapping row'
MSG_NULL_ERROR = '"{}" is nullable but "{}" is NOT NULL — no default value or handling logic given'
MSG_NULL_INFO = 'Nullable "{}" → NOT NULL "{}": will wrap in COALESCE with default {}'
MSG_TYPE = "{} ({}) → {} ({}) with no sql_logic — cast will be generated"
MSG_LOOKUP = 'Row references lookup table "{}" — verify the generated join/CASE logic'
MSG_DRIFT = "Schema MD lists columns not present in live table {}: {}"
MSG_NO_SELECT = "Generated .sqlx contains no SELECT statement"
AUDIT_COUNT_FAIL = "row counts do not match"
AUDIT_NULL_FAIL = 'nulls found in required column "{}"'

# ---------------------------------------------------------------------------
# Finding check numbers: findings (1-4) come before errors (5-9), each
# check in row order, as a run stores them.
# ---------------------------------------------------------------------------
CHECK_EXCLUDED = 1
CHECK_NULL_INFO = 2
CHECK_TYPE = 3
CHECK_LOOKUP = 4
CHECK_NO_ACTIVE = 5
CHECK_MISSING = 6
CHECK_DUPLICATE = 7
CHECK_UNMAPPED = 8
CHECK_NULL_ERROR = 9

# ---------------------------------------------------------------------------
# Table shapes
# ---------------------------------------------------------------------------
MAPPING_ROWS_SCHEMA = T.StructType(
    [T.StructField("sheet_id", T.LongType()), T.StructField("row_no", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in MAPPING_COLUMNS]
)

SCHEMA_COLUMNS_SCHEMA = T.StructType([
    T.StructField("sheet_id", T.LongType()),
    T.StructField("side", T.StringType()),          # 'source' | 'target'
    T.StructField("table_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("description", T.StringType()),
])

FINDINGS_SCHEMA = T.StructType([
    T.StructField("sheet_id", T.LongType()),
    T.StructField("check_no", T.IntegerType()),
    T.StructField("row_key", T.LongType()),
    T.StructField("sub_no", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rows", T.StringType()),
    T.StructField("message", T.StringType()),
])
