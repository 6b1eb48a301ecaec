"""Validation: sheets with their findings worked out by hand, and properties of many sheets together."""
from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.model import MAPPING_COLUMNS, MAPPING_ROWS_SCHEMA
from maplift.operators.validate import Validator

SCHEMA = ("sheet_id bigint, side string, table_name string, ordinal int, column_name string, type string, nullable boolean, "
          "description string")
SOURCE = [("a", "VARCHAR", True), ("b", "FLOAT", False), ("c", "TIMESTAMP", True)]
TARGET = [("x", "INTEGER", False), ("y", "VARCHAR", True), ("z", "DATE", True)]


def mapping(spark, sheets):
    rows = [(s, i + 2, *[r.get(c, "") for c in MAPPING_COLUMNS]) for s, rs in sheets.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, MAPPING_ROWS_SCHEMA)


def columns(spark, sheets, source=SOURCE, target=TARGET):
    rows = [(s, side, f"{side}.t{s}", i + 1, n, t, nl, "") for s in sheets
            for side, cols in (("source", source), ("target", target)) for i, (n, t, nl) in enumerate(cols)]
    return spark.createDataFrame(rows, SCHEMA)


def findings(v):
    out = {}
    for r in v.all_findings().orderBy("sheet_id", "check_no", "row_key", "sub_no").collect():
        out.setdefault(r.sheet_id, []).append((r.severity, r.rows, r.message))
    return out


def row(source, target, **more):
    return {"source_field": source, "target_field": target, **more}


def test_each_check_by_hand(spark):
    sheets = {
        1: [row("b", "x"), row("a", "y"), row("c", "z")],
        2: [row("a", "x"), row("q", "y"), row("a", "w"), row("a", "y", mapping_status="draft")],
        3: [row("a", "x", default_value="it's"), row("b", "x", lookup_table="lk", sql_logic="f(b)")],
        4: [row("a", "x", mapping_status="In Progress")],
        5: [row("b", "x", nullable=" y ")],
    }
    got = findings(Validator(mapping(spark, sheets), columns(spark, sheets)))
    cast = "with no sql_logic — cast will be generated"
    assert got[1] == [("warning", "2", f"b (FLOAT) → x (INTEGER) {cast}"), ("warning", "4", f"c (TIMESTAMP) → z (DATE) {cast}")]
    assert ("info", "5", '1 row(s) not marked "Validated" — excluded from generation') in got[2]
    assert ("error", "3", 'Source field "q" does not exist in source.t2') in got[2]
    assert ("error", "4", 'Target field "w" does not exist in target.t2') in got[2]
    assert ("warning", "2", f"a (VARCHAR) → x (INTEGER) {cast}") in got[2]
    assert sum(s == "error" and r == "2" for s, r, _ in got[2]) == 1  # nullable source, required target, no default
    assert any(s == "info" and r == "2" and "COALESCE with default \"it's\"" in m for s, r, m in got[3])
    assert any(s == "error" and r == "2, 3" for s, r, _ in got[3])
    assert any(s == "warning" and r == "3" and '"lk"' in m for s, r, m in got[3])
    assert [(s, r) for s, r, _ in got[4]] == [("info", "2"), ("error", "-")]
    assert [(s, r) for s, r, _ in got[5] if s == "error"] == [("error", "2")]


def test_required_target_without_mapping(spark):
    got = findings(Validator(mapping(spark, {1: [row("a", "y")]}), columns(spark, [1])))
    assert [(s, r) for s, r, _ in got[1]] == [("error", "-")] and '"x"' in got[1][0][2]


def test_repeated_schema_column_takes_its_last_type(spark):
    cols = columns(spark, [1], source=[*SOURCE, ("b", "INTEGER", False)])
    assert findings(Validator(mapping(spark, {1: [row("b", "x")]}), cols)) == {}


ROW = st.builds(row, st.sampled_from(["a", "b", "c", "q", ""]), st.sampled_from(["x", "y", "z", "w", ""]),
                mapping_status=st.sampled_from(["", "Validated", " valid ", "draft"]), sql_logic=st.sampled_from(["", "f(x)"]),
                default_value=st.sampled_from(["", "0"]), lookup_table=st.sampled_from(["", "lk"]))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(ROW, min_size=1, max_size=40), min_size=2, max_size=5))
def test_sheets_do_not_influence_one_another(spark, sheets):
    sheets = {i: [r for r in rs if r["source_field"] or r["target_field"]] for i, rs in enumerate(sheets)}
    sheets = {i: rs for i, rs in sheets.items() if rs}
    if not sheets:
        return
    v = Validator(mapping(spark, sheets), columns(spark, sheets), bucket_size=8)  # small buckets, so sheets span several
    together = findings(v)
    one = min(sheets)
    alone = findings(Validator(mapping(spark, {one: sheets[one]}), columns(spark, [one])))
    assert together.get(one) == alone.get(one)
    moved = {i + 100: rs for i, rs in reversed(sheets.items())}
    again = findings(Validator(mapping(spark, moved), columns(spark, moved)))
    assert {i - 100: [(s, r) for s, r, _ in f] for i, f in again.items()} == {i: [(s, r) for s, r, _ in f] for i, f in together.items()}
    for i, found in together.items():
        numbers = {str(k + 2) for k in range(len(sheets[i]))} | {"-"}
        assert all(set(r.split(", ")) <= numbers for _, r, _ in found)
    counts = {r.sheet_id: r.n_active + r.n_excluded for r in v.mapping_counts().collect()}
    assert counts == {i: len(rs) for i, rs in sheets.items()}
    totals = {r.sheet_id: (r.n_errors, r.n_warnings, r.n_infos) for r in v.finding_counts().collect()}
    for i, n in totals.items():
        kinds = [s for s, _, _ in together.get(i, [])]
        assert n == tuple(kinds.count(k) for k in ("error", "warning", "info"))
