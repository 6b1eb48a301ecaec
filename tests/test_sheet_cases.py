"""Mapping sheets: CSV texts with the rows they hold, errors by file, and export as a fixed point."""
import os

import pytest

from maplift.model import MAPPING_COLUMNS
from maplift.session import fresh_path
from maplift.sources.mapping_sheet import (SheetError, export_canonical, mapping_rows_from_records, read_sheet_records,
                                           sheet_file_errors, sheet_texts, write_sheets)

GOOD = [
    # headers in any order and spelling; blank record; NA cell
    ("Target Table,source-field,TARGET FIELD\nt,s1,f1\n,,\nt,NA,f2\n",
     [(2, dict(target_table="t", source_field="s1", target_field="f1")), (4, dict(target_table="t", target_field="f2"))]),
    # a blank header cell keeps its place
    ("source_field,,target_field,target_table,default_value\ns1,junk,t1,tt,dv\n",
     [(2, dict(source_field="s1", target_field="t1", target_table="tt", default_value="dv"))]),
    # of a repeated header the first counts
    ("source_field,target_field,target_table,source_field\na,b,c,d\n", [(2, dict(source_field="a", target_field="b", target_table="c"))]),
    # quoted line breaks, commas and quotes; short records
    ('source_field,target_field,target_table,sql_logic\n"s,1",f,t,"CASE\nWHEN ""x"""\n s2 ,f2\n',
     [(2, dict(source_field="s,1", target_field="f", target_table="t", sql_logic='CASE\nWHEN "x"')),
      (3, dict(source_field="s2", target_field="f2"))]),
    # 200 columns
    (",".join([f"x{i}" for i in range(197)] + ["source_field", "target_field", "target_table"]) + "\n"
     + ",".join([str(i) for i in range(197)] + ["s", "f", "t"]) + "\n", [(2, dict(source_field="s", target_field="f", target_table="t"))]),
]
BAD = [("source_field,target_field\na,b\n", "missing required columns: target_table"),
       ("source_field,target_field,target_table\na,b,c,d\n", "longer than its header: row 2"),
       ("source_field,target_field,target_table\n", "no mapping rows"),
       ("source_field,target_field,target_table,lookup_table\n,,t,\n", "no mapping rows")]


def write(spark, texts):
    root = fresh_path(spark, "sheet_cases")
    for i, t in enumerate(texts):
        os.makedirs(f"{root}/sheet_id={i}")
        with open(f"{root}/sheet_id={i}/sheet.csv", "w") as f:
            f.write(t)
    return root


def rows_of(records):
    out = {}
    for r in mapping_rows_from_records(records).orderBy("sheet_id", "row_no").collect():
        out.setdefault(r.sheet_id, []).append((r.row_no, {c: r[c] for c in MAPPING_COLUMNS if r[c]}))
    return out


def test_rows_of_good_sheets(spark):
    root = write(spark, [t for t, _ in GOOD])
    assert rows_of(read_sheet_records(spark, root)) == {i: want for i, (_, want) in enumerate(GOOD)}
    assert sheet_file_errors(spark, root).count() == 0


def test_errors_name_every_bad_file(spark):
    root = write(spark, [t for t, _ in BAD * 8] + [GOOD[0][0]])
    got = {int(r.file.split("sheet_id=")[1].split("/")[0]): r.error for r in sheet_file_errors(spark, root).collect()}
    assert sorted(got) == list(range(len(BAD) * 8))
    assert all(BAD[i % len(BAD)][1] in e for i, e in got.items())
    with pytest.raises(SheetError, match="and 31 more files"):
        read_sheet_records(spark, root)
    lax = rows_of(read_sheet_records(spark, root, strict=False))
    assert lax == {len(BAD) * 8: GOOD[0][1]}


def test_export_is_a_fixed_point(spark):
    root = write(spark, [t for t, _ in GOOD])
    once = read_sheet_records(spark, root)
    path = fresh_path(spark, "sheet_export")
    export_canonical(once, path)
    again = read_sheet_records(spark, path)
    assert rows_of(again) == rows_of(once)
    assert again.count() == once.count()


def test_texts_of_sheets_are_those_of_their_files(spark):
    cells = [None, "", " a ", "x,y", 'say "hi"', "two\nlines", "\\", "NA", "'", "é", '"', ",", "a\r\nb", '\\"', " "]
    rows = [(s, r + 2, *(cells[(r * 7 + s * 3 + i) % len(cells)] for i in range(len(MAPPING_COLUMNS)))) for s in range(5) for r in range(20)]
    rows.append((9, 2, *["f"] * len(MAPPING_COLUMNS)))
    df = spark.createDataFrame(rows, "sheet_id long, row_no long, " + ", ".join(f"{c} string" for c in MAPPING_COLUMNS))
    headers = {"source_field": "Source, \"Field\"", "target_table": "Target Table"}
    for named in (None, headers):
        path = fresh_path(spark, "texts-case")
        write_sheets(df, path, named)
        files = {r.sheet_id: r.value for r in spark.read.text(path, wholetext=True).collect()}
        texts = sheet_texts(df, named)
        assert {r.sheet_id: r.text for r in texts.collect()} == files and len(files) == 6
        assert {r.file for r in texts.collect()} == {f"sheet_{i}.csv" for i in files}
    table = export_canonical(df, fresh_path(spark, "texts-case"), as_texts=True)
    path = fresh_path(spark, "texts-case")
    export_canonical(df, path)
    got, want = (sorted(tuple(x) for x in read_sheet_records(spark, x).drop("file").collect()) for x in (table, path))
    assert got == want and len(got) == 101
    assert sheet_file_errors(spark, table).count() == 0
    bad = spark.createDataFrame([(1, "up.csv", "a,b\n1,2\n")], "sheet_id long, file string, text string")
    assert [(r.file, r.error[:24]) for r in sheet_file_errors(spark, bad).collect()] == [("up.csv", "STTM sheet is missing re")]
