"""Edge rules of the validator, the rules and the parsers."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from maplift.functions import rules
from maplift.functions.types import type_family
from maplift.model import MAPPING_COLUMNS, MAPPING_ROWS_SCHEMA
from maplift.operators.validate import Validator
from maplift.operators.windows import lag_in_group, ordered_string_agg, row_number_in_group
from maplift.sources.schema_doc import parse_schema_docs, schema_doc_rejects


def sheet(spark, rows):
    recs = []
    for i, r in enumerate(rows):
        d = {c: "" for c in MAPPING_COLUMNS}
        d.update(r)
        recs.append(tuple([0, i + 2] + [d[c] for c in MAPPING_COLUMNS]))
    return spark.createDataFrame(recs, MAPPING_ROWS_SCHEMA)


def schema(spark, src, tgt):
    rows = [(0, "source", "raw.s", i + 1, n, t, nl, "") for i, (n, t, nl) in enumerate(src)]
    rows += [(0, "target", "analytics.t", i + 1, n, t, nl, "") for i, (n, t, nl) in enumerate(tgt)]
    return spark.createDataFrame(rows, "sheet_id bigint, side string, table_name string, ordinal int, "
                                       "column_name string, type string, nullable boolean, description string")


def test_duplicates_triple_and_empty_targets(spark):
    s = sheet(spark, [{"source_field": "a", "target_field": "x"}, {"source_field": "b", "target_field": "x"},
                      {"source_field": "c", "target_field": "x"}, {"source_field": "d", "target_field": ""},
                      {"source_field": "e", "target_field": ""}, {"source_field": "f", "target_field": "y",
                                                                  "mapping_status": "Draft"}])
    v = Validator(s, schema(spark, [("a", "INT", True)], [("x", "INT", True)]))
    d = sorted((r.rows, r.message) for r in v.duplicate_targets().collect())
    assert d == [("2, 3", 'Target field "x" is mapped more than once'),
                 ("3, 4", 'Target field "x" is mapped more than once'),
                 ("5, 6", 'Target field "" is mapped more than once')]


def test_blank_status_is_active_and_other_excluded(spark):
    s = sheet(spark, [{"source_field": "a", "target_field": "x", "mapping_status": ""},
                      {"source_field": "a", "target_field": "y", "mapping_status": "  APPROVED "},
                      {"source_field": "a", "target_field": "z", "mapping_status": "rejected"}])
    v = Validator(s, schema(spark, [("a", "INT", True)], [("x", "INT", True)]))
    assert v.active().count() == 2
    ex = v.excluded_rows_finding().collect()
    assert [(r.rows, r.message) for r in ex] == [("4", '1 row(s) not marked "Validated" — excluded from generation')]


def test_no_active_rows_error_only(spark):
    s = sheet(spark, [{"source_field": "a", "target_field": "x", "mapping_status": "Draft"}])
    v = Validator(s, schema(spark, [("a", "INT", True)], [("x", "INT", False)]))
    f = v.all_findings().collect()
    assert sorted(r.severity for r in f) == ["error", "info"]
    assert any(r.message == "No validated mapping rows remain after status filtering" for r in f)


def test_nullable_sheet_vs_doc(spark):
    # 'NULLABLE' marks a column nullable in a schema document but not in a sheet
    s = sheet(spark, [{"source_field": "a", "target_field": "x", "nullable": "NULLABLE"},
                      {"source_field": "a", "target_field": "y", "nullable": "y"}])
    v = Validator(s, schema(spark, [("a", "INT", False)], [("x", "INT", False), ("y", "INT", False)]))
    errs = sorted(r.rows for r in v.nullability_conflicts().collect())
    assert errs == ["3"]


def test_numeric_precision_family(spark):
    df = spark.createDataFrame([("NUMERIC(10,2)",), ("int64",), (" varchar ",), ("DOUBLE PRECISION",)], "t string")
    assert [r.f for r in df.select(type_family(F.col("t")).alias("f")).collect()] == ["float", "other", "text", "other"]


def test_round_half_even_and_null_concat(spark):
    df = spark.createDataFrame([(82.5, "a", None), (83.5, None, "b"), (-0.5, None, None)], "w double, f string, l string")
    rows = df.select(rules.round_int("w").alias("r"), rules.concat_space("f", "l").alias("c")).collect()
    assert [r.r for r in rows] == [82, 84, 0]
    assert [r.c for r in rows] == ["a ", " b", " "]


def test_clean_rules(spark):
    df = spark.createDataFrame([("  joHN   smITH ",), ("   ",), (None,), ("a\tb",)], "x string")
    rows = df.select(rules.clean_string("x").alias("s"), rules.title_case("x").alias("t"),
                     rules.clean_email("x").alias("e")).collect()
    assert [r.s for r in rows] == ["joHN smITH", None, None, "a b"]
    assert [r.t for r in rows] == ["John   Smith", "", None, "A\tb"]
    assert rows[3].e == "a\tb"


def test_schema_doc_parse_rules(spark):
    doc = ("intro\n# Table: raw.t1\n| column | type | nullable |\n|:--|--|--|\n| a | int | yes | first |\n"
           "| b | varchar(10) | | |\n| too | short |\n| a | text | NULLABLE | again |\n")
    docs = spark.createDataFrame([("d1", doc), ("d2", "no heading\n| a | INT | NO |\n"), ("d3", "# Table: x.y\n")],
                                 "doc_id string, text string")
    p = parse_schema_docs(docs).orderBy("ordinal").collect()
    assert [(r.table_name, r.ordinal, r.column_name, r.type, r.nullable, r.description) for r in p] == [
        ("raw.t1", 1, "a", "TEXT", True, "again"), ("raw.t1", 2, "b", "VARCHAR(10)", False, "")]
    rej = {r.doc_id: r.error for r in schema_doc_rejects(docs).collect()}
    assert set(rej) == {"d2", "d3"}
    assert rej["d3"] == "No column rows found in schema MD for table x.y"


def test_skew_safe_windows_match_plain_windows(spark):
    rnd = random.Random(7)
    rows = [(("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 20)}"), i) for i in rnd.sample(range(5000), 1500)]
    df = spark.createDataFrame(rows, "k string, o long")
    w = Window.partitionBy("k").orderBy("o")
    plain = {(r.k, r.o): (r.p, r.n) for r in df.select("k", "o", F.lag("o").over(w).alias("p"),
                                                           F.row_number().over(w).alias("n")).collect()}
    lag = {(r.k, r.o): r.p for r in lag_in_group(df, ["k"], "o", "p", bucket_size=64).collect()}
    rn = {(r.k, r.o): r.n for r in row_number_in_group(df, ["k"], "o", "n", bucket_size=64).collect()}
    assert lag == {k: v[0] for k, v in plain.items()}
    assert rn == {k: v[1] for k, v in plain.items()}
    agg = {r.k: r.s for r in ordered_string_agg(df, ["k"], ["o"], F.col("o").cast("string"), ",", "s",
                                                bucket_size=64).collect()}
    want = {}
    for k, o in sorted(rows, key=lambda x: x[1]):
        want.setdefault(k, []).append(str(o))
    assert agg == {k: ",".join(v) for k, v in want.items()}


def test_skew_safe_running_sum(spark):
    from maplift.operators.windows import running_sum_in_group
    rnd = random.Random(3)
    rows = [(("hot" if rnd.random() < 0.6 else "cold"), i, rnd.randint(0, 9)) for i in rnd.sample(range(3000), 800)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = {(r.k, r.o): r.s for r in df.select("k", "o", F.sum("v").over(w).alias("s")).collect()}
    got = {(r.k, r.o): r.v_cum for r in running_sum_in_group(df, ["k"], "o", ["v"], bucket_size=50).collect()}
    assert got == plain


def test_loadable_sheets(spark):
    good = sheet(spark, [{"source_field": "a", "target_field": "x"}])
    bad = sheet(spark, [{"source_field": "zz", "target_field": "x"}]).withColumn("sheet_id", F.lit(1).cast("bigint"))
    cols = schema(spark, [("a", "INT", False)], [("x", "INT", True)])
    cols = cols.unionByName(cols.withColumn("sheet_id", F.lit(1).cast("bigint")))
    v = Validator(good.unionByName(bad), cols)
    assert [r.sheet_id for r in v.loadable_sheets().collect()] == [0]


def test_schema_doc_whitespace_like_python(spark):
    doc = "# Table: raw.t2\r\n\t| a | INT\t| yes |\r\n| b | TEXT | no | | c | DATE | y | d |"
    docs = spark.createDataFrame([("d", doc)], "doc_id string, text string")
    got = [(r.column_name, r.type, r.nullable, r.description) for r in parse_schema_docs(docs).orderBy("ordinal").collect()]
    assert got == [("a", "INT", True, ""), ("b", "TEXT", False, ""), ("c", "DATE", True, "d")]


def test_catalog_columns_feed_schema_drift(spark):
    from maplift.operators.validate import schema_drift
    from maplift.sources.catalog import catalog_columns
    live = catalog_columns(spark, {"raw.p": spark.createDataFrame([(1, "a")], "id int, name string")})
    assert [(r.ordinal, r.column_name, r.type) for r in live.orderBy("ordinal").collect()] == \
        [(1, "id", "INTEGER"), (2, "name", "VARCHAR")]
    declared = spark.createDataFrame([(0, "raw.p", 1, "id"), (0, "raw.p", 2, "zip"), (0, "raw.p", 3, "age")],
                                     "sheet_id bigint, table_name string, ordinal int, column_name string")
    drift = schema_drift(declared, live.withColumn("sheet_id", F.lit(0).cast("bigint"))).collect()
    assert [(r.missing_columns, r.message) for r in drift] == [
        ("zip, age", "Schema MD lists columns not present in live table raw.p: zip, age")]
