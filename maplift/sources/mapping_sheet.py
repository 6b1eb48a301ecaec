"""Mapping sheets as CSV texts.

Sheets come as a folder of files, or as a table of texts with a row per sheet (`sheet_id`, `file`, `text`): uploads and canonical
sheets are kept as texts of a run, and a file and a folder for each of them takes far longer to make, list and open than its text to read.
Each sheet is read once, as one text -- a sheet is a bounded upload -- while many sheets are
read in parallel.  A pattern that knows quotes cuts the text into records and records into
cells, so a record's number is its place in the array: no window, no second parse, no
width taken from other files.  A file's cells are mapped through its own header, so
sheets with different columns and orders read in one job, and what is wrong with a file is known
beside its records.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.functions.text import normalize_header, py_strip
from maplift.model import MAPPING_COLUMNS, PANDAS_NA_VALUES, REQUIRED_SHEET_COLUMNS
from maplift.session import fresh_path

# A quote opens a quoted cell only at the cell's start; it ends with a quote that is not doubled, or with
# the file.  All repetitions are possessive: linear time and no recursion on long cells.
_QUOTED = r'"(?:[^"]++|"")*+'
_BREAK = r"(?:\r\n|\r|\n)"
_CELL = rf'(?:{_QUOTED}(?:"[^,\r\n]*+|\z)|[^,\r\n]*+)'
RECORD = rf"{_CELL}(?:,{_CELL})*+(?:{_BREAK}|\z)"
#: A cell of one record and the comma behind it.
CELL = rf'(?:{_QUOTED}(?:"[^,]*+,|\z)|[^,]*+,)'
QUOTED_CELL = r'(?s)\A"((?:[^"]++|"")*+)"?+(.*+)\z'
BLANK = rf"\A[ \t]*+{_BREAK}?\z"


class SheetError(ValueError):
    pass


def csv_records(text: Column) -> Column:
    """The records of a CSV text in order, blank lines left out, each with its line end."""
    whole = F.regexp_replace(text, "\\A\ufeff", "")
    return F.filter(F.regexp_extract_all(whole, F.lit(RECORD), 0), lambda r: ~r.rlike(BLANK))


def csv_cells(record: Column) -> Column:
    """The cells of one record, without their quotes."""
    def value(cell: Column) -> Column:
        raw = F.substring(cell, F.lit(1), F.length(cell) - 1)
        inner = F.replace(F.regexp_extract(raw, QUOTED_CELL, 1), F.lit('""'), F.lit('"'))
        return F.when(raw.startswith('"'), F.concat(inner, F.regexp_extract(raw, QUOTED_CELL, 2))).otherwise(raw)
    line = F.concat(F.regexp_replace(record, rf"{_BREAK}\z", ""), F.lit(","))
    return F.transform(F.regexp_extract_all(line, F.lit(CELL), 0), value)


def _clean(cell: Column) -> Column:
    return F.when(cell.isNull() | cell.isin(PANDAS_NA_VALUES), F.lit("")).otherwise(py_strip(cell))


def parsed_sheets(spark: SparkSession, sheets: str | DataFrame) -> DataFrame:
    """One row per file (of a folder, or of a table of texts): [sheet_id,] file, the cells of its records (header left out), where each canonical
    column is in them (-1: nowhere), the header's width, and its error or NULL.  One scan, no shuffle."""
    if isinstance(sheets, DataFrame):
        raw = sheets.withColumnRenamed("text", "value")
    else:
        raw = spark.read.text(sheets, wholetext=True).withColumn("file", F.input_file_name())
    keys = [F.col("sheet_id").cast("bigint").alias("sheet_id")] if "sheet_id" in raw.columns else []
    cells = raw.select(*keys, "file", F.transform(csv_records(F.col("value")), csv_cells).alias("all"))
    keys = [c for c in ("sheet_id", "file") if c in cells.columns]
    header = F.coalesce(F.get("all", F.lit(0)), F.array().cast("array<string>"))
    named = cells.select(*keys, F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))).alias("records"),
                         F.transform(header, normalize_header).alias("names"))
    place = F.struct(*((F.array_position("names", F.lit(c)) - 1).cast("int").alias(c) for c in MAPPING_COLUMNS))
    missing = F.filter(F.array(*[F.lit(c) for c in REQUIRED_SHEET_COLUMNS]), lambda c: ~F.array_contains(F.col("names"), c))
    placed = named.select(*keys, "records", place.alias("place"), F.size("names").alias("width"), missing.alias("missing"))
    too_long = F.transform("records", lambda r: _too_long(r, F.col("width")))
    fields = [F.col(f"place.{c}") for c in ("source_field", "target_field")]
    filled = F.exists("records", lambda r: ~_too_long(r, F.col("width")) & (
        (_clean(F.get(r, fields[0])) != "") | (_clean(F.get(r, fields[1])) != "")))
    first_long = F.array_position(too_long, F.lit(True))
    error = (F.when(F.size("missing") > 0, F.concat(F.lit("STTM sheet is missing required columns: "), F.array_join("missing", ", ")))
             .when(first_long > 0, F.concat(F.lit("STTM sheet has a record longer than its header: row "), (first_long + 1).cast("string")))
             .when(~filled, F.lit("STTM sheet has no mapping rows")))
    return placed.select(*keys, "records", "place", "width", (F.size("missing") == 0).alias("usable"), error.alias("error"))


def _too_long(record: Column, width: Column) -> Column:
    """Whether a record has something in a cell beyond its header."""
    return (F.size(record) > width) & F.exists(F.slice(record, width + 1, F.greatest(F.size(record), F.lit(1))), lambda c: c != "")


def _records(sheets: DataFrame) -> DataFrame:
    """Records in canonical columns: of files with the required columns, without over-long records."""
    keys = [c for c in ("sheet_id", "file") if c in sheets.columns]
    rows = (sheets.where("usable").select(*keys, "place", "width", F.posexplode("records").alias("at", "cells"))
            .where(~_too_long(F.col("cells"), F.col("width"))))
    # two projections: each cell is looked up once, then cleaned
    found = rows.select(*keys, (F.col("at") + 2).cast("bigint").alias("row_no"),
                        *[F.when(F.col(f"place.{c}") >= 0, F.get("cells", F.col(f"place.{c}"))).alias(c) for c in MAPPING_COLUMNS])
    front = [c for c in keys if c == "sheet_id"]
    return found.select(*front, *[_clean(F.col(c)).alias(c) for c in MAPPING_COLUMNS], "file", "row_no")


def sheet_file_errors(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, error) for sheets that lack a required column, have a record longer than their header,
    or have no mapping row."""
    return parsed_sheets(spark, path).where(F.col("error").isNotNull()).select("file", "error")


def read_sheet_records(spark: SparkSession, path: str | DataFrame, strict: bool = True) -> DataFrame:
    """All records of all sheet files under `path` (or of a table of texts) in canonical columns, each
    file mapped through its own header, with the spreadsheet row number
    (record index + 2, i.e. the record number counting the header).

    `strict`: raise when a file has an error.  The files are then parsed into a staged table first, which
    errors and records are read from; else what can be read is returned, and
    `sheet_file_errors` lists every file with an error."""
    sheets = parsed_sheets(spark, path)
    if strict:
        staged = fresh_path(spark, "sheets_parsed")
        sheets.write.parquet(staged)
        sheets = spark.read.schema(sheets.schema).parquet(staged)
        bad = (sheets.where(F.col("error").isNotNull())
               .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "error")).alias("first")).first())
        if bad.n:
            more = f" (and {bad.n - 1} more files, see sheet_file_errors)" if bad.n > 1 else ""
            raise SheetError(f"{bad['first'].file}: {bad['first'].error}{more}")
    return _records(sheets)


def mapping_rows_from_records(records: DataFrame) -> DataFrame:
    """A2: records with a source or a target field (blank records dropped)."""
    return records.where((F.col("source_field") != "") | (F.col("target_field") != ""))


def write_sheets(records: DataFrame, path: str, headers: dict[str, str] | None = None) -> None:
    """One CSV file per sheet (RFC-4180 quoting), records in row order."""
    headers = headers or {}
    out = records.select("sheet_id", "row_no", *[F.col(c).alias(headers.get(c, c)) for c in MAPPING_COLUMNS])
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not merged: a file per sheet takes its time
    (out.repartition(tasks, "sheet_id").sortWithinPartitions("sheet_id", "row_no").drop("row_no")
     .write.partitionBy("sheet_id").option("header", True).option("escape", '"')
     .mode("errorifexists").csv(path))


def sheet_texts(records: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """(sheet_id, file, text): each sheet as the CSV text that `write_sheets` would write."""
    headers, quoting = headers or {}, {"escape": '"'}
    names = F.to_csv(F.struct(*[F.lit(headers.get(c, c)).alias(c) for c in MAPPING_COLUMNS]), quoting)
    line = F.to_csv(F.struct(*MAPPING_COLUMNS), quoting)
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not merged: the texts are small, parsing them is not
    lines = records.select("sheet_id", F.struct("row_no", line.alias("line")).alias("r")).repartition(tasks, "sheet_id")
    found = lines.groupBy("sheet_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.concat(names, F.lit("\n"), F.array_join(F.transform("rs", lambda r: r["line"]), "\n"), F.lit("\n"))
    return found.select("sheet_id", F.concat(F.lit("sheet_"), F.col("sheet_id").cast("string"), F.lit(".csv")).alias("file"), text.alias("text"))


def keep_texts(texts: DataFrame, path: str) -> DataFrame:
    """A table of sheet texts, written and read again."""
    texts.write.mode("errorifexists").parquet(path)
    return texts.sparkSession.read.schema(texts.schema).parquet(path)


def export_canonical(records: DataFrame, path: str, as_texts: bool = False) -> DataFrame | None:
    """A10: the normalised sheet (all records, blank ones included, so row
    numbers survive a re-read) written back as CSV: a file per sheet, or (`as_texts`) a
    row per sheet of a table of texts, which is returned."""
    if as_texts:
        return keep_texts(sheet_texts(records), path)
    write_sheets(records, path)
