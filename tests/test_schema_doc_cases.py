"""Schema documents: hand-written texts with the columns they declare, and documents rendered from columns."""
from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.sources.schema_doc import parse_schema_docs, render_schema_docs, schema_doc_rejects

HEAD = "# Table: raw.t1\n"
CASES = [
    (HEAD + "| column | type | nullable | description |\n|---|---|---|---|\n| a | varchar | YES | first |\n| b | int | no | |\n",
     [("a", "VARCHAR", True, "first"), ("b", "INT", False, "")]),
    (HEAD + "  | a | int | y |", [("a", "INT", True, "")]),
    (HEAD + "| a | int | nullable | x | more |", [("a", "INT", True, "x")]),
    (HEAD + "| a | int | YES | one |\n| b | date | NO | |\n| a | text | no | two |", [("a", "TEXT", False, "two"), ("b", "DATE", False, "")]),
    (HEAD + "| only | two |\ntext | a | b | c\n| :-: | x | y |\n| Column | x | y |\n| c | bool | true | |", [("c", "BOOL", True, "")]),
]
REJECTED = [("| a | int | NO |", "Schema MD must start"), ("", "Schema MD must start"), (HEAD, "No column rows found"),
            (HEAD + "| only | two |", "No column rows found")]


def docs_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def parsed(df):
    out = {}
    for r in parse_schema_docs(df).orderBy("doc_id", "ordinal").collect():
        out.setdefault(r.doc_id, []).append((r.column_name, r.type, r.nullable, r.description))
        assert r.ordinal == len(out[r.doc_id])
    return out


def test_declared_columns(spark):
    df = docs_of(spark, [t for t, _ in CASES])
    assert parsed(df) == {str(i): want for i, (_, want) in enumerate(CASES)}
    assert schema_doc_rejects(df).count() == 0


def test_rejects(spark):
    df = docs_of(spark, [t for t, _ in REJECTED])
    got = {r.doc_id: r.error for r in schema_doc_rejects(df).collect()}
    assert all(got[str(i)].startswith(want) for i, (_, want) in enumerate(REJECTED))
    assert parsed(df) == {}


COLUMNS = st.lists(st.tuples(st.sampled_from(["INT", "VARCHAR(9)", "DATE"]), st.booleans(), st.sampled_from(["", "some text", "x y"])),
                   min_size=1, max_size=8)


@settings(max_examples=4, deadline=None)
@given(st.lists(COLUMNS, min_size=1, max_size=6))
def test_rendered_columns_come_back(spark, tables):
    rows = [(i, f"raw.t{i}", j + 1, f"c{j}", t, n, d) for i, cols in enumerate(tables) for j, (t, n, d) in enumerate(cols)]
    schema = spark.createDataFrame(rows, "sheet_id int, table_name string, ordinal int, column_name string, type string, "
                                         "nullable boolean, description string")
    docs = render_schema_docs(schema, ["sheet_id"]).selectExpr("cast(sheet_id as string) as doc_id", "text")
    assert parsed(docs) == {str(i): [(f"c{j}", t, n, d) for j, (t, n, d) in enumerate(cols)] for i, cols in enumerate(tables)}
