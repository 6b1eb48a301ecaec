"""Several sheets loaded with one read of their source, each audited by itself; suggestions for wrong names."""
import pytest
from pyspark.sql import functions as F

from maplift.model import MAPPING_ROWS_SCHEMA
from maplift.operators.load import current_files, read_current
from maplift.operators.validate import Validator
from maplift.plans.mapping import sample_schema_columns
from maplift.plans.workflow import run_mapping, run_mappings
from maplift.session import fresh_path
from maplift.sources.samples import sample_sheet, sample_sheet_records
from tests.test_sample_mapping import LOAD_TS, seed_df


def sheets_of(spark, *edits):
    """One copy of the sample sheet per edit; an edit maps a row number to the fields it changes."""
    rows = [dict(r, sheet_id=i) | edit.get(r["row_no"], {}) for i, edit in enumerate(edits) for r in sample_sheet_records()]
    return spark.createDataFrame([tuple(r[f.name] for f in MAPPING_ROWS_SCHEMA.fields) for r in rows], MAPPING_ROWS_SCHEMA)


def run(spark, edits, source=None, schema=None):
    roots = {i: fresh_path(spark, f"shared_{i}") for i in range(len(edits))}
    schema = sample_schema_columns(spark, list(roots)) if schema is None else schema
    source = seed_df(spark) if source is None else source
    return roots, run_mappings(sheets_of(spark, *edits), schema, source, roots, LOAD_TS)


def test_sheets_load_as_they_do_alone(spark):
    upper = {4: {"sql_logic": "UPPER(cust_email_01)"}}
    roots, results = run(spark, [{}, upper])
    assert [results[i].status for i in (0, 1)] == ["succeeded"] * 2
    alone = fresh_path(spark, "alone")
    one = run_mapping(sample_sheet(spark), sample_schema_columns(spark, [0]), seed_df(spark), alone, LOAD_TS)
    assert results[0].findings == one.findings and results[0].audit == one.audit
    assert sorted(read_current(spark, roots[0]).collect()) == sorted(read_current(spark, alone).collect())
    assert read_current(spark, roots[0]).dtypes == read_current(spark, alone).dtypes
    got = {r.patient_id: r.email_address for r in read_current(spark, roots[1]).collect()}
    assert got["P-0003"] == "ARUN.K@EMAIL.COM"


def test_the_source_is_read_once(spark):
    """Rows of the source are counted as they are read: three sheets, one pass."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    source = seed_df(spark)
    source = source.mapInArrow(count, source.schema)
    _, results = run(spark, [{}, {}, {}], source)
    assert [r.status for r in results.values()] == ["succeeded"] * 3
    assert read.value == 10


def test_one_sheet_fails_alone(spark):
    edits = [{}, {3: {"source_field": "customer_email"}}, {4: {"transformation_rule": "no such rule", "sql_logic": ""}},
             {5: {"sql_logic": "CAST(first_name AS DATE)"}}]
    roots, results = run(spark, edits)
    assert [results[i].status for i in range(4)] == ["succeeded", "failed", "failed", "failed"]
    assert [results[i].failed_step for i in range(4)] == [None, "validate", "compile", "execute"]
    assert read_current(spark, roots[0]).count() == 10
    assert all(current_files(spark, roots[i]) is None for i in (1, 2, 3))


def test_an_audit_fails_alone(spark):
    schema = sample_schema_columns(spark, [0, 1])
    strict = schema.withColumn("nullable", F.when((F.col("sheet_id") == 1) & (F.col("column_name") == "weight"), False)
                               .when((F.col("sheet_id") == 1) & (F.col("column_name") == "weight_kg"), False).otherwise(F.col("nullable")))
    edits = [{}, {6: {"sql_logic": "CAST(ROUND(weight_kg) AS INTEGER)"}}]
    roots, results = run(spark, edits, schema=strict)
    assert results[0].status == "succeeded" and read_current(spark, roots[0]).count() == 10
    assert (results[1].status, results[1].failed_step, results[1].audit["bad_col"]) == ("failed", "audit", "weight")
    assert current_files(spark, roots[1]) is None


def test_a_sheet_without_rows(spark):
    roots = {0: fresh_path(spark, "a"), 5: fresh_path(spark, "b")}
    results = run_mappings(sheets_of(spark, {}), sample_schema_columns(spark, [0, 5]), seed_df(spark), roots, LOAD_TS)
    assert results[0].status == "succeeded" and results[5].failed_step == "validate"


def suggested(spark, source=None, target=None, schema=None):
    sheet = sheets_of(spark, {4: {"source_field": source or "cust_email_01", "target_field": target or "email_address"}})
    schema = sample_schema_columns(spark, [0]) if schema is None else schema
    return [(r.side, r.field, r.suggestion, r.edits) for r in Validator(sheet, schema).field_suggestions().collect()]


@pytest.mark.parametrize("field, want", [
    ("customer_email", ("cust_email_01", 7)),  # the wrong column of the first attempt of the sample run
    ("patient_ID", ("patient_id", 2)), ("weigth_kg", ("weight_kg", 2)), ("q", (None, None)), ("something_else_entirely", (None, None))])
def test_suggestions_for_a_wrong_source_field(spark, field, want):
    assert suggested(spark, source=field) == [("source", field, *want)]


def test_suggestions_ties_sides_and_missing_schemas(spark):
    cols = [(0, "source", "t", o, c, "INT", True, "") for o, c in ((3, "ab1"), (1, "ab2"), (2, "ab3"))]
    schema = spark.createDataFrame(cols, "sheet_id long, side string, table_name string, ordinal int, column_name string, type string, "
                                         "nullable boolean, description string")
    v = Validator(sheets_of(spark, {}).where("row_no = 2").withColumn("source_field", F.lit("ab9")), schema)
    got = sorted((r.side, r.field, r.suggestion, r.edits) for r in v.field_suggestions().collect())
    assert got == [("source", "ab9", "ab2", 1), ("target", "patient_id", None, None)]
    assert Validator(sheets_of(spark, {}), schema.where("false")).field_suggestions().where("suggestion is not null").count() == 0
    assert suggested(spark) == []
