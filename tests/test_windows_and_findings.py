"""Windows cut by range against plain windows, findings of one flow against the single checks, sheets against csv."""
import csv
import io
import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from maplift.operators import windows
from maplift.operators.validate import Validator
from maplift.operators.windows import lag_in_group, ordered_string_agg, row_number_in_group, running_sum_in_group
from maplift.plans.q_validate import validator
from maplift.session import fresh_path
from maplift.sources import derived
from maplift.sources.mapping_sheet import csv_cells, csv_records, read_sheet_records, sheet_file_errors
from tests.conftest import SF_SMALL
from tests.test_plans import plan


# ------------------------------------------------------------------ windows
def frames(spark):
    rng = random.Random(4)
    epoch = 1_700_000_000_000_000_000
    shapes = {"nanoseconds": lambda i: epoch + rng.randrange(10**15), "hashes": lambda i: rng.randrange(-2**63, 2**63),
              "ties": lambda i: rng.choice([1, 2, 2**62, None]), "null": lambda i: None, "equal": lambda i: 7, "dense": lambda i: i}
    rows = []
    for name, order in shapes.items():
        rows += [(name, order(i), rng.choice([None, 1, 5, i]), i) for i in range(700)]
    rows += [(None, i % 9, i, i) for i in range(300)] + [("few", 3, 1, 1), ("few", None, None, 2)]
    return spark.createDataFrame(rows, "g string, o long, v long, id long")


def grouped(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, Counter())[tuple(r[c] for c in cols)] += 1
    return out


@pytest.mark.parametrize("size, group, sampled", [(50, 64, 24), (7, 3, 24), (100, 2, 2), (10**6, 64, 24)])
def test_range_cut_windows_equal_plain_ones(spark, monkeypatch, size, group, sampled):
    monkeypatch.setattr(windows, "EDGE_GROUP", group)
    monkeypatch.setattr(windows, "SAMPLED", sampled)
    df = frames(spark)
    w = Window.partitionBy("g").orderBy("o")
    assert grouped(lag_in_group(df, ["g"], "o", "p", size), "o", "p") == grouped(df.withColumn("p", F.lag("o").over(w)), "o", "p")
    got = row_number_in_group(df, ["g"], "o", "n", size)
    assert grouped(got, "o", "n") == grouped(df.withColumn("n", F.row_number().over(w).cast("bigint")), "o", "n")
    assert sorted(got.drop("n").collect(), key=str) == sorted(df.collect(), key=str)
    # running sums: equal order values may be added in any order, so the sum after the last of them is compared
    plain = df.withColumn("v_cum", F.sum("v").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    last = {(r.g, r.o): r.v_cum for r in plain.collect()}
    sums = running_sum_in_group(df, ["g"], "o", ["v"], bucket_size=size)
    ends = {}
    for r in sums.collect():
        ends.setdefault((r.g, r.o), []).append(r.v_cum)
    assert {k: max((x for x in v if x is not None), default=None) for k, v in ends.items()} == last
    assert sums.columns == [*df.columns, "v_cum"]


@pytest.mark.parametrize("order", ["id * 1000003 + 1700000000000000000", "xxhash64(id)", "cast(null as bigint)", "id % 2"])
def test_a_hot_key_is_spread_whatever_its_order_values(spark, order):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20000).select(F.lit("hot").alias("k"), F.expr(order).alias("o"), "id")
        split = row_number_in_group(df, ["k"], "o", "n", bucket_size=500)
        sizes = split.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c"), F.max("n")).collect()
        assert max(r.c for r in sizes) <= 10000 and len(sizes) >= 6
        assert [r.n for r in split.orderBy("n").select("n").collect()] == list(range(1, 20001))
        b = windows._by_range(df, ["k"], "o", 500).groupBy("_b").count().collect()
        assert len(b) >= 30 and max(r["count"] for r in b) <= 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ordered_string_agg_leaves_out_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 9, "y"), ("b", 1, None)], "k string, o int, v string")
    got = {r.k: (r.s, r.n) for r in ordered_string_agg(df, ["k"], ["o"], F.col("v"), ",", "s", bucket_size=2, count_col="n").collect()}
    assert got == {"a": ("x,y", 3), "b": ("", 1)}


# ------------------------------------------------------------------ findings
def single_checks(v):
    parts = [v.excluded_rows_finding(), v.row_findings(), v.no_active_errors(), v.duplicate_targets(), v.unmapped_required_targets()]
    return Counter(tuple(r) for p in parts for r in p.collect())


def random_catalog(spark, seed):
    rng = random.Random(seed)
    rows, cols = [], []
    for sheet in range(4):
        for side in ("source", "target"):
            for i in range(6):
                cols.append((sheet, side, f"{side}_{sheet}", i, f"{side[0]}{rng.randrange(5)}", rng.choice(["INT", "VARCHAR", "FLOAT", "DATE"]),
                             rng.random() < 0.5, ""))
        for i in range(rng.choice([1, 7, 30])):
            rows.append((sheet, i + 2, rng.choice(["", "s0", "s1", "s2", "zz"]), rng.choice(["", "t0", "t1", "t2", "t3", "qq"]),
                         rng.choice(["YES", ""]), rng.choice(["", "x"]), rng.choice(["", "", "d'"]), rng.choice(["", "lk"]),
                         rng.choice(["", "Valid", "draft"]) if sheet else "draft"))
    rows.append((9, 2, "a", "b", "", "", "", "", "valid"))  # a sheet without a schema
    r = spark.createDataFrame(rows, "sheet_id long, row_no long, source_field string, target_field string, nullable string, sql_logic string, "
                                    "default_value string, lookup_table string, mapping_status string")
    r = r.withColumn("source_table", F.lit("src")).withColumn("target_table", F.lit("tgt"))
    c = spark.createDataFrame(cols, "sheet_id long, side string, table_name string, ordinal int, column_name string, type string, nullable boolean, "
                                    "description string")
    return r, c


@pytest.mark.parametrize("seed, size", [(0, 1 << 16), (1, 4), (2, 1)])
def test_one_flow_equals_the_single_checks(spark, seed, size):
    v = Validator(*random_catalog(spark, seed), bucket_size=size)
    got = v.all_findings()
    assert Counter(tuple(r) for r in got.collect()) == single_checks(v)
    found = [r.asDict() for r in got.collect()]
    sheets = {r.sheet_id for r in v.sheet_summary().collect()}
    names = {"error": "n_errors", "warning": "n_warnings", "info": "n_infos"}
    for counts in (v.finding_counts(), v.finding_counts(got)):
        assert {r.sheet_id: (r.n_errors, r.n_warnings, r.n_infos) for r in counts.collect()} == {
            s: tuple(sum(f["sheet_id"] == s and f["severity"] == x for f in found) for x in names) for s in sheets}
    for notes in (v.finding_notes(), v.finding_notes(got)):
        want = {s: "\n".join(f"- row {f['rows']}: {f['message']}" for f in sorted(
            (f for f in found if f["sheet_id"] == s and f["severity"] != "error"), key=lambda f: (f["check_no"], f["row_key"], f["sub_no"])))
            or "none" for s in sheets}
        assert {r.sheet_id: r.notes for r in notes.collect()} == want
    assert {r.sheet_id for r in v.loadable_sheets().collect()} == {s for s in sheets if not any(
        f["sheet_id"] == s and f["severity"] == "error" for f in found)}


def test_findings_read_rows_and_schemas_once(spark):
    for df in (validator(spark, SF_SMALL).all_findings(), validator(spark, SF_SMALL).finding_counts(), validator(spark, SF_SMALL).finding_notes()):
        assert len(re.findall(r"^\(\d+\) Scan parquet", plan(df), flags=re.M)) == 2


def test_findings_of_an_empty_catalog(spark):
    rows = derived.mapping_rows(spark, SF_SMALL).where("false")
    v = Validator(rows, derived.schema_columns(spark, SF_SMALL))
    assert v.all_findings().count() == v.finding_counts().count() == v.finding_notes().count() == 0


# ------------------------------------------------------------------ sheets
CELLS = st.text(alphabet='ab ",\n\r\té€', max_size=6)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(CELLS, min_size=1, max_size=4), min_size=1, max_size=6), st.sampled_from(["\n", "\r\n"]), st.booleans())
def test_records_equal_the_csv_module(spark, rows, end, last_end):
    buf = io.StringIO()
    csv.writer(buf, lineterminator=end).writerows(rows)
    text = buf.getvalue() if last_end else buf.getvalue()[: -len(end)]
    df = spark.createDataFrame([(text,)], "t string").select(F.transform(csv_records(F.col("t")), csv_cells).alias("r"))
    want = [r for r in rows if not (len(r) == 1 and not r[0].strip(" \t") and '"' not in _written(r))]
    assert df.first().r == want


def _written(row):
    buf = io.StringIO()
    csv.writer(buf).writerow(row)
    return buf.getvalue()


@pytest.mark.parametrize("text, want", [
    ('a"b,c"d\n', [['a"b', 'c"d']]),  # quotes inside a cell are text
    ('"a"x,y\n', [["ax", "y"]]),  # text behind a closing quote
    ('"a ""b"" c",\n', [['a "b" c', ""]]),
    ('a,"open\nb,c\n', [["a", "open\nb,c"]]),  # never closed: the rest of the file but its last line end
    ("﻿a,b\r\n\r\n  \r\n,\r\nc", [["a", "b"], ["", ""], ["c"]]),  # mark at the start, blank lines, commas only
    ("", []), ("\n\n", []), ('""\n', [[""]]), ("x" * 300_000 + ',"' + '""' * 100_000 + '"\n', [["x" * 300_000, '"' * 100_000]]),
])
def test_records_of_odd_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(F.transform(csv_records(F.col("t")), csv_cells).alias("r"))
    assert df.first().r == want


def test_sheets_are_read_once(spark):
    root = fresh_path(spark, "once")
    for i in range(3):
        os.makedirs(f"{root}/sheet_id={i}")
        with open(f"{root}/sheet_id={i}/s.csv", "w") as f:
            f.write("source_field,target_field,target_table\r\ns,t,u\r\n")
    for df in (read_sheet_records(spark, root, strict=False), sheet_file_errors(spark, root)):
        p = plan(df)
        assert len(re.findall(r"^\(\d+\) Scan ", p, flags=re.M)) == 1 and "Exchange" not in p and "Window" not in p
    strict = plan(read_sheet_records(spark, root))
    assert "Scan text" not in strict and "Scan csv" not in strict  # parsed before, staged
    assert [r.row_no for r in read_sheet_records(spark, root).collect()] == [2, 2, 2]
