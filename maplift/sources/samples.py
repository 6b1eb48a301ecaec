"""The sample mapping, as fixed values.

This is the demo mapping of the mapping tool (one source table of patients,
one target fact table).  `apply_mapping` runs it over the `patients` input
derived from `customer`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maplift.model import MAPPING_COLUMNS, MAPPING_ROWS_SCHEMA

# The sample sheet, in sheet order (sheet rows 2-10).
SAMPLE_SHEET_HEADER = (
    "source_table,source_field,source_type,nullable,sample_data,transformation_rule,"
    "sql_logic,lookup_table,default_value,target_table,target_field,target_type,mapping_status"
)
SAMPLE_SHEET_ROWS = [
    ["raw.clinical_patients", "patient_id", "VARCHAR", "NO", "P-0001", "Copy as-is", "", "", "",
     "analytics.fct_clinical_patients", "patient_id", "VARCHAR", "Validated"],
    ["raw.clinical_patients", "first_name", "VARCHAR", "YES", "John", "Concatenate first and last name with a space",
     "CONCAT(first_name, ' ', last_name)", "", "", "analytics.fct_clinical_patients", "full_name", "VARCHAR", "Validated"],
    ["raw.clinical_patients", "cust_email_01", "VARCHAR", "YES", "John.DOE@Email.com",
     "Clean email: trim whitespace and lowercase", "", "", "",
     "analytics.fct_clinical_patients", "email_address", "VARCHAR", "Validated"],
    ["raw.clinical_patients", "dob", "VARCHAR", "YES", "1985-03-14", "Parse ISO-8601 string to date", "", "", "",
     "analytics.fct_clinical_patients", "date_of_birth", "DATE", "Validated"],
    ["raw.clinical_patients", "weight_kg", "FLOAT", "YES", "82.4", "Round to nearest integer", "", "", "",
     "analytics.fct_clinical_patients", "weight", "INTEGER", "Validated"],
    ["raw.clinical_patients", "site_code", "VARCHAR", "YES", "01", "Map site code to city name",
     "CASE site_code WHEN '01' THEN 'Chennai' WHEN '02' THEN 'Mumbai' WHEN '03' THEN 'Delhi' ELSE 'Unknown' END",
     "site_lookup", "Unknown", "analytics.fct_clinical_patients", "site_city", "VARCHAR", "Validated"],
    ["raw.clinical_patients", "enrolled_flag", "VARCHAR", "YES", "Y", "Convert Y/N flag to boolean",
     "(enrolled_flag = 'Y')", "", "", "analytics.fct_clinical_patients", "is_enrolled", "BOOLEAN", "Validated"],
    ["raw.clinical_patients", "created_at", "TIMESTAMP", "YES", "2026-06-01 09:15:00", "Stamp load time",
     "NOW()", "", "NOW()", "analytics.fct_clinical_patients", "_loaded_at", "TIMESTAMP", "Validated"],
    ["raw.clinical_patients", "site_code", "VARCHAR", "YES", "01", "Keep raw site code for QA", "", "", "",
     "analytics.fct_clinical_patients", "site_code_raw", "VARCHAR", "In Progress"],
]

# The two sample schema documents.
SAMPLE_SOURCE_SCHEMA_MD = """# Table: raw.clinical_patients

| column | type | nullable | description |
|---|---|---|---|
| patient_id | VARCHAR | NO | Unique patient identifier |
| first_name | VARCHAR | YES | Patient first name |
| last_name | VARCHAR | YES | Patient last name |
| cust_email_01 | VARCHAR | YES | Raw email, inconsistent casing/whitespace |
| dob | VARCHAR | YES | Date of birth as ISO-8601 string |
| weight_kg | FLOAT | YES | Weight in kilograms |
| site_code | VARCHAR | YES | Trial site code: 01, 02, 03 |
| enrolled_flag | VARCHAR | YES | 'Y' or 'N' |
| created_at | TIMESTAMP | YES | Record creation time |
"""

SAMPLE_TARGET_SCHEMA_MD = """# Table: analytics.fct_clinical_patients

| column | type | nullable | description |
|---|---|---|---|
| patient_id | VARCHAR | NO | Unique patient identifier |
| full_name | VARCHAR | YES | first + last name |
| email_address | VARCHAR | YES | Cleaned email |
| date_of_birth | DATE | YES | Parsed date of birth |
| weight | INTEGER | YES | Weight rounded to integer kg |
| site_city | VARCHAR | YES | City resolved from site_code |
| is_enrolled | BOOLEAN | YES | Enrollment flag as boolean |
| _loaded_at | TIMESTAMP | NO | Load timestamp |
"""

# Fixed load time used wherever the oracle must see the same value as NOW().
DEFAULT_LOAD_TS = "2026-06-10 00:00:00"


def sample_sheet_records(sheet_id: int = 0) -> list[dict]:
    return [dict(zip(MAPPING_COLUMNS, r), sheet_id=sheet_id, row_no=i + 2)
            for i, r in enumerate(SAMPLE_SHEET_ROWS)]


def sample_sheet(spark: SparkSession, sheet_id: int = 0) -> DataFrame:
    recs = sample_sheet_records(sheet_id)
    rows = [tuple(r[f.name] for f in MAPPING_ROWS_SCHEMA.fields) for r in recs]
    return spark.createDataFrame(rows, MAPPING_ROWS_SCHEMA)
