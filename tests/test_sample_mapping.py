"""The sample mapping end to end: golden findings and golden target rows."""
import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from maplift.model import MAPPING_COLUMNS
from maplift.operators.validate import Validator
from maplift.plans.compile import ColumnSpec, apply_mapping, sheet_rows_of
from maplift.plans.mapping import sample_schemas
from maplift.sources.samples import (SAMPLE_SOURCE_SCHEMA_MD, SAMPLE_TARGET_SCHEMA_MD, sample_sheet,
                                     sample_sheet_records)
from maplift.sources.schema_doc import parse_schema_docs

# Ten demo source rows (test fixture).
SEED = [
    ("P-0001", "John", "Doe", "  John.DOE@Email.com ", "1985-03-14", 82.4, "01", "Y", "2026-06-01 09:15:00"),
    ("P-0002", "Priya", "Sharma", "priya.sharma@email.com", "1992-11-02", 61.0, "02", "Y", "2026-06-01 10:20:00"),
    ("P-0003", "Arun", "Kumar", "ARUN.K@email.com", "1978-07-23", None, "03", "N", "2026-06-02 08:05:00"),
    ("P-0004", "Meera", "Iyer", None, "1989-01-30", 55.6, "01", "Y", "2026-06-02 12:40:00"),
    ("P-0005", "David", "Lee", "david.lee@email.com", "1995-09-17", 70.2, "02", "Y", "2026-06-03 09:00:00"),
    ("P-0006", "Sara", "Khan", "sara.khan@Email.com", "1983-05-08", 68.9, "03", "N", "2026-06-03 15:30:00"),
    ("P-0007", "Ravi", "Menon", "ravi.menon@email.com", None, 77.1, "01", "Y", "2026-06-04 11:10:00"),
    ("P-0008", "Anna", "Petrov", "anna.petrov@email.com", "1990-12-25", 59.3, "02", "Y", "2026-06-04 16:45:00"),
    ("P-0009", "Tom", "Nguyen", "tom.n@email.com", "1987-04-11", None, "03", "Y", "2026-06-05 10:00:00"),
    ("P-0010", "Lakshmi", "Rao", "lakshmi.rao@email.com", "1993-08-19", 63.7, "01", "N", "2026-06-05 14:20:00"),
]
GOLDEN = [
    ("P-0001", "John Doe", "john.doe@email.com", "1985-03-14", 82, "Chennai", True),
    ("P-0002", "Priya Sharma", "priya.sharma@email.com", "1992-11-02", 61, "Mumbai", True),
    ("P-0003", "Arun Kumar", "arun.k@email.com", "1978-07-23", None, "Delhi", False),
    ("P-0004", "Meera Iyer", None, "1989-01-30", 56, "Chennai", True),
    ("P-0005", "David Lee", "david.lee@email.com", "1995-09-17", 70, "Mumbai", True),
    ("P-0006", "Sara Khan", "sara.khan@email.com", "1983-05-08", 69, "Delhi", False),
    ("P-0007", "Ravi Menon", "ravi.menon@email.com", None, 77, "Chennai", True),
    ("P-0008", "Anna Petrov", "anna.petrov@email.com", "1990-12-25", 59, "Mumbai", True),
    ("P-0009", "Tom Nguyen", "tom.n@email.com", "1987-04-11", None, "Delhi", True),
    ("P-0010", "Lakshmi Rao", "lakshmi.rao@email.com", "1993-08-19", 64, "Chennai", False),
]
LOAD_TS = "2026-06-10 00:00:00"


def seed_df(spark):
    df = spark.createDataFrame(SEED, "patient_id string, first_name string, last_name string, cust_email_01 string, "
                                     "dob string, weight_kg double, site_code string, enrolled_flag string, "
                                     "created_at string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_golden_target_rows(spark):
    src, tgt = sample_schemas(spark)
    out = apply_mapping(seed_df(spark), sheet_rows_of(sample_sheet(spark)), src, tgt, LOAD_TS)
    assert out.columns == ["patient_id", "full_name", "email_address", "date_of_birth", "weight", "site_city",
                           "is_enrolled", "_loaded_at"]
    rows = sorted(out.collect())
    got = [(r[0], r[1], r[2], r[3].isoformat() if r[3] else None, r[4], r[5], r[6]) for r in rows]
    assert got == GOLDEN
    assert all(r[7] == dt.datetime(2026, 6, 10) for r in rows)
    types = dict(out.dtypes)
    assert types["date_of_birth"] == "date" and types["weight"] == "int" and types["is_enrolled"] == "boolean"


def test_wrong_column_fails_analysis(spark):
    src, tgt = sample_schemas(spark)
    recs = sample_sheet_records()
    recs[2]["sql_logic"] = "TRIM(LOWER(customer_email))"
    with pytest.raises(AnalysisException):
        apply_mapping(seed_df(spark), recs, src, tgt, LOAD_TS)


def _schema_columns(spark):
    docs = spark.createDataFrame([("source", SAMPLE_SOURCE_SCHEMA_MD), ("target", SAMPLE_TARGET_SCHEMA_MD)],
                                 "doc_id string, text string")
    p = parse_schema_docs(docs)
    return p.select(F.lit(0).cast("bigint").alias("sheet_id"), F.col("doc_id").alias("side"), "table_name",
                    "ordinal", "column_name", "type", "nullable", "description")


def test_golden_findings(spark):
    v = Validator(sample_sheet(spark), _schema_columns(spark))
    f = v.all_findings().orderBy("check_no", "row_key", "sub_no").collect()
    got = [(r.severity, r.rows, r.message) for r in f]
    assert got == [
        ("info", "10", '1 row(s) not marked "Validated" — excluded from generation'),
        ("info", "9", "Nullable \"created_at\" → NOT NULL \"_loaded_at\": will wrap in COALESCE with default 'NOW()'"),
        ("warning", "5", "dob (VARCHAR) → date_of_birth (DATE) with no sql_logic — cast will be generated"),
        ("warning", "6", "weight_kg (FLOAT) → weight (INTEGER) with no sql_logic — cast will be generated"),
        ("warning", "7", 'Row references lookup table "site_lookup" — verify the generated join/CASE logic'),
    ]
    counts = v.mapping_counts().collect()[0]
    assert (counts.n_active, counts.n_excluded) == (8, 1)
    notes = v.finding_notes().collect()[0].notes
    assert notes.splitlines()[0] == '- row 10: 1 row(s) not marked "Validated" — excluded from generation'
    assert len(notes.splitlines()) == 5


def test_sample_schema_parse(spark):
    src, tgt = sample_schemas(spark)
    assert list(src)[0] == "patient_id" and not src["patient_id"].nullable
    assert src["weight_kg"] == ColumnSpec("FLOAT", True)
    assert [n for n, c in tgt.items() if not c.nullable] == ["patient_id", "_loaded_at"]
    assert MAPPING_COLUMNS[-1] == "mapping_status"


def test_run_mapping_end_to_end(spark):
    from maplift.plans.workflow import run_mapping
    from maplift.session import fresh_path
    root = fresh_path(spark, "test_run")
    res = run_mapping(sample_sheet(spark), _schema_columns(spark), seed_df(spark), root, LOAD_TS)
    assert res.status == "succeeded", res
    assert (res.audit["rows_written"], res.audit["counts_match"], res.audit["null_violations"]) == (10, True, 0)
    assert len(res.findings) == 5
    from maplift.operators.load import read_current
    assert read_current(spark, root).count() == 10
    # a broken sheet stops at validation
    bad = sample_sheet(spark).withColumn("source_field", F.when(F.col("row_no") == 4, "customer_email")
                                         .otherwise(F.col("source_field")))
    res2 = run_mapping(bad, _schema_columns(spark), seed_df(spark), fresh_path(spark, "test_run"), LOAD_TS)
    assert res2.status == "failed" and res2.failed_step == "validate"
    assert any(f["message"] == 'Source field "customer_email" does not exist in raw.clinical_patients'
               for f in res2.findings)


def test_record_run_feeds_history(spark):
    from maplift.operators.history import run_kpis
    from maplift.operators.load import read_current
    from maplift.plans.workflow import record_run, run_mapping
    from maplift.session import fresh_path
    runs_root, feed_root = fresh_path(spark, "test_runs"), fresh_path(spark, "test_feed")
    res = run_mapping(sample_sheet(spark), _schema_columns(spark), seed_df(spark), fresh_path(spark, "t"), LOAD_TS)
    record_run(spark, runs_root, feed_root, "run_a", "analytics.fct_clinical_patients", res, 0, 65_000, 8, 1)
    bad = sample_sheet(spark).withColumn("target_field", F.lit("x"))
    res2 = run_mapping(bad, _schema_columns(spark), seed_df(spark), fresh_path(spark, "t"), LOAD_TS)
    record_run(spark, runs_root, feed_root, "run_b", "analytics.fct_clinical_patients", res2, 0, 5_000, 8, 1)
    k = run_kpis(read_current(spark, runs_root)).first()
    assert (k.total_runs, k.success_rate, k.avg_duration) == (2, 50, "35s")
    assert read_current(spark, feed_root).where(F.col("run_id") == "run_a").count() == 5


def test_generated_select_expressions_compile_to_golden(spark):
    """The demo's generated SELECT, one expression per row as sql_logic."""
    exprs = ["patient_id", "CONCAT(first_name, ' ', last_name)", "TRIM(LOWER(cust_email_01))",
             "CAST(dob AS DATE)", "CAST(ROUND(weight_kg) AS INTEGER)",
             "CASE site_code WHEN '01' THEN 'Chennai' WHEN '02' THEN 'Mumbai' WHEN '03' THEN 'Delhi' "
             "ELSE 'Unknown' END", "(enrolled_flag = 'Y')", "NOW()"]
    recs = sample_sheet_records()
    for r, e in zip(recs, exprs):
        r["sql_logic"] = e
    src, tgt = sample_schemas(spark)
    out = apply_mapping(seed_df(spark), recs, src, tgt, LOAD_TS)
    got = [(r[0], r[1], r[2], r[3].isoformat() if r[3] else None, r[4], r[5], r[6]) for r in sorted(out.collect())]
    assert got == GOLDEN
    ties = spark.createDataFrame([(82.5,), (83.5,)], "weight_kg double")
    recs2 = [dict(recs[4], row_no=2)]
    t = apply_mapping(ties, recs2, {"weight_kg": ColumnSpec("FLOAT", True)}, {"weight": ColumnSpec("INTEGER", True)})
    assert sorted(r.weight for r in t.collect()) == [82, 84]
