"""Rules called from a sheet, SQL rewriting, and the edge cases of loads."""
import os

import pytest
from pyspark.sql import functions as F

from maplift.functions import rules
from maplift.operators import load
from maplift.operators.windows import lag_in_group, row_number_in_group
from maplift.plans.compile import ColumnSpec, MappingError, apply_mapping, sheet_rows_of
from maplift.session import fresh_path, shared_dir
from maplift.sources.tables import read_table


def mapped(spark, row, target=None, columns="w double, d decimal(5,1), code string, name string", data=(82.5, 2.5, "01", "n")):
    src = spark.createDataFrame([tuple(__import__("decimal").Decimal(str(v)) if i == 1 else v for i, v in enumerate(data))], columns)
    row = {"row_no": 2, "source_field": "w", "target_field": "t", "mapping_status": "", **row}
    return apply_mapping(src, [row], {}, target or {"t": ColumnSpec(row.get("target_type", "VARCHAR"), True)}, "2026-06-10 00:00:00").first().t


@pytest.mark.parametrize("rule,source,typ,want", [
    ("unit_convert(2.54, 1)", "w", "DOUBLE", 32.5), ("siteLookup(code)", "code", "VARCHAR", "Chennai"),
    ("concat_space(name)", "code", "VARCHAR", "01 n"), ("concat_space(name, code)", "code", "VARCHAR", "n 01"),
    ("code_case('01', 'a, b', 'z')", "code", "VARCHAR", "a, b"), ("flag_bool('01')", "code", "BOOLEAN", True),
    ("Copy as-is", "name", "VARCHAR", "n"), ("round_int", "w", "INTEGER", 82)])
def test_rules_called_from_a_sheet(spark, rule, source, typ, want):
    assert mapped(spark, {"transformation_rule": rule, "source_field": source, "target_type": typ}) == want


@pytest.mark.parametrize("rule", ["no_such_rule", "Copy as-is but mask digits", "unit_convert(1, 2, 3)", "code_case('a', 'b')",
                                  "flag_bool(nowhere)", "clean_email(a b)"])
def test_other_rules_are_errors(spark, rule):
    with pytest.raises(MappingError, match="row 2"):
        mapped(spark, {"transformation_rule": rule})


@pytest.mark.parametrize("sql,typ,want", [
    ("ROUND(COALESCE(w,0))", "DOUBLE", 82.0), ("ROUND(d)", "INTEGER", 3), ("CAST(w + 1 AS INTEGER)", "INTEGER", 84),
    ("CAST(d AS INTEGER)", "INTEGER", 3), ("CONCAT('round(x)', code, NULL)", "VARCHAR", "round(x)01"),
    ("CURRENT_TIMESTAMP", "VARCHAR", "2026-06-10 00:00:00"), ("'select it''s'", "VARCHAR", "select it's"),
    ('upper("name")', "VARCHAR", "N"), ("CASE WHEN w > 1 THEN ROUND(w, 0) ELSE 0 END", "DOUBLE", 83.0)])
def test_sql_is_rewritten_on_tokens(spark, sql, typ, want):
    assert mapped(spark, {"sql_logic": sql, "target_type": typ}) == want


@pytest.mark.parametrize("sql", ["(SELECT 1)", "w::int", "ROUND((w)"])
def test_sql_that_is_not_covered_is_an_error(spark, sql):
    with pytest.raises(MappingError, match="row 2"):
        mapped(spark, {"sql_logic": sql})


def test_numeric_keeps_its_digits():
    assert rules.spark_type_name("NUMERIC") == "decimal(38,18)"
    assert rules.spark_type_name("numeric(12)") == "decimal(12,0)"


def test_rows_of_two_sheets_are_refused(spark):
    with pytest.raises(MappingError, match="more than one"):
        sheet_rows_of(spark.createDataFrame([(1, 2), (2, 2)], "sheet_id int, row_no int"))


def test_unknown_rule_fails_the_run(spark):
    from maplift.plans.workflow import run_mapping
    from maplift.sources.samples import sample_sheet
    from tests.test_sample_mapping import _schema_columns, seed_df
    sheet = sample_sheet(spark).withColumn("transformation_rule", F.when(F.col("row_no") == 2, "no_such_rule").otherwise(F.col("transformation_rule")))
    res = run_mapping(sheet, _schema_columns(spark), seed_df(spark), fresh_path(spark, "t"))
    assert (res.status, res.failed_step) == ("failed", "compile")
    assert any(f["severity"] == "error" and f["rows"] == "2" and "no_such_rule" in f["message"] for f in res.findings)


def test_appends_are_audited_by_batch_before_they_count(spark):
    from maplift.plans.workflow import run_mapping
    from maplift.sources.samples import sample_sheet
    from tests.test_sample_mapping import _schema_columns, seed_df
    root, args = fresh_path(spark, "appended"), (sample_sheet(spark), _schema_columns(spark))
    for n in (10, 20):
        res = run_mapping(*args, seed_df(spark), root, full_refresh=False)
        assert res.status == "succeeded", res
        assert load.read_current(spark, root).count() == n
    bad = seed_df(spark).withColumn("patient_id", F.lit(None).cast("string"))
    assert run_mapping(*args, bad, root, full_refresh=False).failed_step == "audit"
    assert load.read_current(spark, root).count() == 20


def test_second_writer_of_a_version_raises(spark):
    root, one = fresh_path(spark, "raced"), spark.range(1)
    load.full_refresh_load(one, root)
    base = load._base(spark, root)
    load.append_load(spark.range(10, 12), root)
    late = load._staged(spark.range(20, 22), root, None, (), None)
    with pytest.raises(load.LoadError, match="committed first"):
        load._commit(spark, root, "append", late, base)
    assert sorted(r.id for r in load.read_current(spark, root).collect()) == [0, 10, 11]


def test_an_unreadable_log_is_not_a_new_table(spark):
    root = fresh_path(spark, "unreadable")
    load.full_refresh_load(spark.range(1), root)
    os.makedirs(f"{root}/versions_log/version=oops")
    with open(f"{root}/versions_log/version=oops/part-0.txt", "w") as f:
        f.write("refresh\tx\n")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark reports, but not a silent full refresh
        load.append_load(spark.range(2), root)


def test_upsert_with_null_versions_and_keys(spark):
    schema = "k int, v string, version int"
    target = spark.createDataFrame([(1, "old", 5), (2, "keep", 1), (None, "none", 1)], schema)
    source = spark.createDataFrame([(1, "new", None), (3, "a", None), (3, "b", 1), (None, "other", 2)], schema)
    got = {(r.k, r.v, r.version) for r in load.scd1_merge(target, source, ["k"], "version").collect()}
    assert got == {(1, "new", None), (2, "keep", 1), (3, "b", 1), (None, "other", 2)}


def test_incremental_takes_a_repeated_key_once(spark):
    schema = "id int, ts timestamp, v string"
    ts = "timestamp'2026-01-0{} 00:00:00'"
    def rows(*r):
        return spark.sql(" union all ".join(f"select {i} id, {ts.format(d)} ts, '{v}' v" for i, d, v in r))
    target, source = rows((1, 5, "t")), rows((1, 5, "again"), (2, 6, "b"), (2, 5, "a"), (3, 4, "edge"), (4, 3, "late"))
    got = {(r.id, r.v) for r in load.fact_incremental(source, target, "ts", ["id"], "1 day").collect()}
    assert got == {(2, "a"), (3, "edge")} and schema


def test_replaced_partitions(spark):
    root = fresh_path(spark, "parts")
    events = spark.sql("select id, timestamp_seconds(id * 43200) as ts from range(8)")
    load.partitioned_load(events, root, "ts")
    load.replace_partitions(events.where("id = 2").withColumn("id", F.lit(99).cast("bigint")), root, "ts")
    assert sorted(r.id for r in load.read_current(spark, root).collect()) == [0, 1, 4, 5, 6, 7, 99]


def test_null_groups_are_numbered_like_others(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5), ("a", None)], "g string, o int")
    got = {(r.g, r.o): r.n for r in row_number_in_group(df, ["g"], "o", "n", 2).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", None): 1, ("a", 5): 2}
    got = {(r.g, r.o): r.p for r in lag_in_group(df, ["g"], "o", "p", 2).collect()}
    assert got == {(None, 1): None, (None, 2): 1, ("a", None): None, ("a", 5): None}


def test_a_schema_is_a_folder(spark):
    root = fresh_path(spark, "schemas")
    spark.range(1).write.parquet(f"{root}/t.parquet")
    spark.range(2).write.parquet(f"{root}/mart/t.parquet")
    assert [read_table(spark, root, n).count() for n in ("t", "raw.t", "mart.t")] == [1, 1, 2]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_streams_read_a_table_of_part_files(spark):
    from maplift.plans.q_stream import q_feed_append_stream, q_latest_run_state_stream
    from tests.conftest import SF_SMALL
    root = fresh_path(spark, "folders")
    for t in ("events", "orders"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(3).write.parquet(f"{root}/{t}.parquet")
    for q in (q_feed_append_stream, q_latest_run_state_stream):
        assert sorted(map(str, q(spark, root).collect())) == sorted(map(str, q(spark, SF_SMALL).collect()))
