"""Model-file text rules, sheet reading, loads and audits."""
import os

import pytest
from pyspark.sql import functions as F

from maplift.operators import audit, load
from maplift.session import fresh_path
from maplift.sources.mapping_sheet import SheetError, mapping_rows_from_records, read_sheet_records
from maplift.sources.model_files import fenced_blocks, model_bodies, model_ref_edges


def test_model_bodies_rules(spark):
    files = spark.createDataFrame([
        ("a", 'config { a: { b: { c: 1 } } }\njs { x }\nSELECT 1 FROM ${ref("t")} JOIN ${ ref("s.u") } ;;\n'),
        ("b", "config { unbalanced \nselect 2"),
        ("c", "-- no query here"),
        ("d", "config {}\n-- a comment with Select inside\nSELECT 3"),
    ], "path string, text string")
    got = {r.path: (r.body, r.error) for r in model_bodies(files).collect()}
    assert got["a"] == ("SELECT 1 FROM raw.t JOIN s.u ", None)
    assert got["b"] == ("select 2", None)
    assert got["c"] == (None, "Generated .sqlx contains no SELECT statement")
    assert got["d"][0].startswith("Select inside")
    edges = sorted((r.path, r.ref_table) for r in model_ref_edges(files).collect())
    assert edges == [("a", "raw.t"), ("a", "s.u")]


def test_fenced_blocks(spark):
    msgs = spark.createDataFrame([(1, "x\n```sql\nSELECT 1\n```\n```sqlx\nSELECT 2\n```"), (2, "  plain \n"),
                                  (3, "```\n\n```")], "id int, text string")
    got = {r.id: r.body for r in fenced_blocks(msgs).collect()}
    assert got == {1: "SELECT 1", 2: "plain", 3: ""}


def test_sheet_rows_and_headers(spark):
    path = fresh_path(spark, "test_sheet")
    os.makedirs(path + "/sheet_id=1")
    with open(path + "/sheet_id=1/a.csv", "w") as f:
        f.write("Source Field,TARGET-FIELD,Target Table,Mapping Status,Sample Data\n"
                "a,x,t,Validated,NA\n\n,,,,\n"
                'b,y,t, draft ,"two\nlines"\n'
                "c,z,t,,null\n")
    recs = read_sheet_records(spark, path)
    rows = sorted((r.row_no, r.source_field, r.mapping_status, r.sample_data, r.source_table)
                  for r in mapping_rows_from_records(recs).collect())
    assert rows == [(2, "a", "Validated", "", ""), (4, "b", "draft", "two\nlines", ""), (5, "c", "", "", "")]
    bad = fresh_path(spark, "test_sheet_bad")
    os.makedirs(bad)
    with open(bad + "/b.csv", "w") as f:
        f.write("source,target\n1,2\n")
    with pytest.raises(SheetError):
        read_sheet_records(spark, bad)


def test_full_refresh_keeps_old_version_on_failed_check(spark):
    root = fresh_path(spark, "test_table")
    df1 = spark.range(5).withColumn("v", F.lit("a"))
    load.full_refresh_load(df1, root)
    df2 = spark.range(3).withColumn("v", F.lit(None).cast("string"))

    def check(written):
        a = audit.load_audit(df2, written, ["id", "v"]).collect()[0]
        if not a.ok:
            raise load.LoadError(a.failed_check)
    with pytest.raises(load.LoadError, match='nulls found in required column "v"'):
        load.full_refresh_load(df2, root, check)
    assert load.read_current(spark, root).count() == 5
    load.append_load(df1, root)
    assert load.read_current(spark, root).count() == 10


def test_audit_counts_and_nulls(spark):
    src = spark.range(10)
    tgt = spark.range(9).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(1).alias("a"),
                                F.when(F.col("id") == 1, None).otherwise(1).alias("b"))
    a = audit.load_audit(src, tgt, ["a", "b"]).collect()[0]
    assert (a.source_rows, a.rows_written, a.counts_match, a.null_violations, a.bad_col, a.ok, a.failed_check) == \
        (10, 9, False, 4, "a", False, "row counts do not match")
    nv = [(r.column_name, r.null_count) for r in audit.null_violations(tgt, ["a", "b"]).orderBy("ordinal").collect()]
    assert nv == [("a", 3), ("b", 1)]
    assert audit.null_rows(tgt, ["a", "b"]).count() == 4


def test_scd1_merge_latest_wins(spark):
    tgt = spark.createDataFrame([(1, "old", 0), (2, "keep", 0)], "k int, v string, ver int")
    src = spark.createDataFrame([(1, "v1", 1), (1, "v2", 2), (3, "new", 1)], "k int, v string, ver int")
    got = sorted(tuple(r) for r in load.scd1_merge(tgt, src, ["k"], "ver").collect())
    assert got == [(1, "v2", 2), (2, "keep", 0), (3, "new", 1)]


def test_require_run(spark):
    from maplift.operators.history import require_run
    from maplift.sources import derived
    from tests.conftest import SF_SMALL
    runs = derived.runs(spark, SF_SMALL)
    assert require_run(runs, "run_7")["status"] == "succeeded"
    with pytest.raises(LookupError):
        require_run(runs, "run_does_not_exist")


def test_sheet_file_errors_and_lax_read(spark):
    from maplift.sources.mapping_sheet import sheet_file_errors
    path = fresh_path(spark, "test_sheet_mixed")
    os.makedirs(path + "/sheet_id=1")
    os.makedirs(path + "/sheet_id=2")
    with open(path + "/sheet_id=1/a.csv", "w") as f:
        f.write("Target Table,Source Field,Target Field\nt,a,x\n")
    with open(path + "/sheet_id=2/b.csv", "w") as f:
        f.write("Source Field,Target Field\nb,y\n")
    errs = [(r.file.rsplit("/", 2)[-2], r.error) for r in sheet_file_errors(spark, path).collect()]
    assert errs == [("sheet_id=2", "STTM sheet is missing required columns: target_table")]
    rows = [(r.sheet_id, r.source_field, r.target_table) for r in read_sheet_records(spark, path, strict=False).collect()]
    assert rows == [(1, "a", "t")]
