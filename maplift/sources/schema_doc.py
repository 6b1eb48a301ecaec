"""A1: schema documents (markdown tables) -> `schema_columns` rows.

Works over a DataFrame of documents `(doc_id, text)`, so any number of
documents parse in one job.  Each document is one row; its lines are
exploded with their position, filtered and parsed with built-in string
functions.  A document is bounded (one table's column list), so the
per-document window that numbers its columns is bounded too.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maplift.model import DOC_NULLABLE_VALUES
from maplift.functions.text import py_strip

TABLE_HEADING = r"(?m)^#\s*Table:\s*([\w.]+)"
# Line breaks as Python's str.splitlines() sees them (fixed list).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def read_schema_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (doc_id = file path, text)."""
    return (spark.read.option("wholetext", True).text(path)
            .select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")))


def _cells(line: Column) -> Column:
    """Cells of a table line: outer pipes stripped, split on '|', trimmed."""
    return F.transform(F.split(F.regexp_replace(py_strip(line), r"^\|+|\|+$", ""), r"\|", -1),
                       lambda c: py_strip(c))


def _is_column_row(line: Column, cells: Column | None = None) -> Column:
    """A line that declares a column: starts with '|', has 3+ cells, and its
    first cell is not blank, not the header word, not a separator."""
    cells = _cells(line) if cells is None else cells
    name = cells[0]
    return (py_strip(line).startswith("|") & (F.size(cells) >= 3)
            & ~F.lower(name).isin("column", "") & ~name.rlike(r"^[-: ]+$"))


def parse_schema_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, table_name, ordinal, column_name, type, nullable, description)
    for every well-formed document."""
    d = docs.select("doc_id", F.regexp_extract("text", TABLE_HEADING, 1).alias("table_name"), "text") \
        .where(F.col("table_name") != "")
    lines = d.select("doc_id", "table_name", F.posexplode(F.split("text", LINE_BREAK)).alias("pos", "line"))
    rows = (lines.select("doc_id", "table_name", "pos", "line", _cells(F.col("line")).alias("cells"))
            .where(_is_column_row(F.col("line"), F.col("cells")))
            .select("doc_id", "table_name", "pos",
                    F.col("cells")[0].alias("column_name"),
                    F.upper(F.col("cells")[1]).alias("type"),
                    F.upper(F.col("cells")[2]).isin(DOC_NULLABLE_VALUES).alias("nullable"),
                    F.when(F.size("cells") > 3, F.col("cells")[3]).otherwise(F.lit("")).alias("description")))
    # a repeated name keeps its first position and its last values
    per_name = (rows.groupBy("doc_id", "table_name", "column_name")
                .agg(F.min("pos").alias("first_pos"),
                     F.max_by(F.struct("type", "nullable", "description"), F.col("pos")).alias("v")))
    w = Window.partitionBy("doc_id").orderBy("first_pos")
    return per_name.select("doc_id", "table_name", F.row_number().over(w).cast("int").alias("ordinal"),
                           "column_name", "v.type", "v.nullable", "v.description")


def schema_doc_rejects(docs: DataFrame) -> DataFrame:
    """(doc_id, error) for documents without a table heading or without any
    column row -- one projection per document, no join."""
    table = F.regexp_extract("text", TABLE_HEADING, 1)
    has_rows = F.exists(F.split("text", LINE_BREAK), lambda line: _is_column_row(line))
    err = (F.when(table == "", F.lit("Schema MD must start with a line like '# Table: raw.clinical_patients'"))
           .when(~has_rows, F.concat(F.lit("No column rows found in schema MD for table "), table)))
    return docs.select("doc_id", err.alias("error")).where(F.col("error").isNotNull())


def render_schema_docs(schema_cols: DataFrame, doc_key: list[str]) -> DataFrame:
    """Build one markdown document per `doc_key` group from schema rows.

    Ordered string aggregate over a bounded group (one table's columns).
    """
    line = F.concat_ws(" | ", F.col("column_name"), F.col("type"),
                       F.when(F.col("nullable"), F.lit("YES")).otherwise(F.lit("NO")), F.col("description"))
    body = (schema_cols.groupBy(*doc_key, "table_name")
            .agg(F.sort_array(F.collect_list(F.struct("ordinal", F.concat(F.lit("| "), line, F.lit(" |")).alias("l"),
                                                      F.col("column_name").alias("name"))))
                 .alias("ls")))
    text = F.concat(F.lit("# Table: "), F.col("table_name"),
                    F.lit("\n\n| column | type | nullable | description |\n|---|---|---|---|\n"),
                    F.array_join(F.transform("ls", lambda s: s["l"]), "\n"), F.lit("\n"))
    return body.select(*doc_key, text.alias("text"), F.col("ls")[0]["name"].alias("first_column"))
