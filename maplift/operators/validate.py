"""Mapping-catalog validation over any number of sheets, as joins.

Inputs are two tables: `mapping_rows` (sheet_id, row_no, 13 canonical
columns) and `schema_columns` (sheet_id, side, table_name, ordinal,
column_name, type, nullable, description).  Every check is a join or a
grouped aggregate keyed by (sheet_id, field), so all sheets are checked in
one job; nothing is collected.

Findings are rows `(sheet_id, check_no, row_key, sub_no, severity, rows,
message)`; `(check_no, row_key, sub_no)` gives the order a run shows them
in: informational findings first, then errors, each check in row order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift import model as M
from maplift.functions.text import py_repr, py_strip
from maplift.functions.types import lossy_pair, type_family
from maplift.operators.windows import lag_in_group, ordered_string_agg


def _fmt(template: str, *cols: Column) -> Column:
    """Fill a `{}` template with columns (string concatenation, JVM-side)."""
    pieces = template.split("{}")
    out: list[Column] = [F.lit(pieces[0])]
    for c, p in zip(cols, pieces[1:]):
        out += [c.cast("string"), F.lit(p)]
    return F.concat(*out)


def is_active(status: Column) -> Column:
    return F.lower(py_strip(status)).isin(M.ACTIVE_STATUSES)


def _finding(df: DataFrame, check_no: int, row_key: Column, sub_no: Column | int, severity: str | Column,
             rows: Column, message: Column) -> DataFrame:
    return df.select(
        F.col("sheet_id").cast("bigint").alias("sheet_id"),
        F.lit(check_no).cast("int").alias("check_no"),
        row_key.cast("bigint").alias("row_key"),
        (sub_no if isinstance(sub_no, Column) else F.lit(sub_no)).cast("int").alias("sub_no"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        rows.cast("string").alias("rows"),
        message.alias("message"))


class Validator:
    """All checks over `mapping_rows` x `schema_columns` (lazy DataFrames)."""

    def __init__(self, mapping_rows: DataFrame, schema_columns: DataFrame, bucket_size: int = 1 << 16):
        self.bucket_size = bucket_size
        rows = mapping_rows.where((F.col("source_field") != "") | (F.col("target_field") != ""))
        self.rows = rows.withColumn("active", is_active(F.col("mapping_status")))
        self.schema = schema_columns
        self.src = schema_columns.where(F.col("side") == "source")
        self.tgt = schema_columns.where(F.col("side") == "target")

    # ---- C1 / E1 -------------------------------------------------------------
    def active(self) -> DataFrame:
        return self.rows.where("active").drop("active")

    def excluded(self) -> DataFrame:
        return self.rows.where(~F.col("active")).drop("active")

    def sheet_summary(self) -> DataFrame:
        """One row per sheet: active and excluded counts and the excluded row
        numbers joined in row order -- one two-level aggregate (per row
        bucket, then per sheet) that E1, E7 and D3 all read."""
        if getattr(self, "_summary", None) is None:
            b = self.rows.select("sheet_id", "row_no", "active",
                                 F.floor(F.col("row_no") / F.lit(self.bucket_size)).cast("bigint").alias("_b"))
            excluded_nos = F.sort_array(F.collect_list(F.when(~F.col("active"), F.col("row_no"))))
            part = b.groupBy("sheet_id", "_b").agg(
                F.array_join(F.transform(excluded_nos, lambda x: x.cast("string")), ", ").alias("_part"),
                F.count_if(F.col("active")).alias("_na"), F.count_if(~F.col("active")).alias("_ne"))
            parts = F.sort_array(F.collect_list(F.when(F.col("_part") != "", F.struct("_b", "_part"))))
            self._summary = part.groupBy("sheet_id").agg(
                F.sum("_na").cast("bigint").alias("n_active"), F.sum("_ne").cast("bigint").alias("n_excluded"),
                F.array_join(F.transform(parts, lambda x: x["_part"]), ", ").alias("excluded_rows"))
        return self._summary

    def mapping_counts(self) -> DataFrame:
        return self.sheet_summary().select("sheet_id", "n_active", "n_excluded")

    # ---- C6 / H2 ---------------------------------------------------------------
    def required_columns(self) -> DataFrame:
        return self.tgt.where(~F.col("nullable")).select("sheet_id", "table_name", "ordinal", "column_name")

    def mapped_targets(self) -> DataFrame:
        return self.active().select("sheet_id", "target_field").distinct()

    # ---- findings ------------------------------------------------------------
    def excluded_rows_finding(self) -> DataFrame:  # E7, check 1
        j = self.sheet_summary().where(F.col("n_excluded") > 0)
        return _finding(j, M.CHECK_EXCLUDED, F.lit(0), 0, "info", F.col("excluded_rows"),
                        _fmt(M.MSG_EXCLUDED, F.col("n_excluded")))

    def no_active_errors(self) -> DataFrame:  # E1, check 5
        c = self.mapping_counts().where(F.col("n_active") == 0)
        return _finding(c, M.CHECK_NO_ACTIVE, F.lit(0), 0, "error", F.lit("-"), F.lit(M.MSG_NO_ACTIVE))

    # ---- row-level checks (C7, D1, D2, D4, D5) in one pass ---------------------
    def schema_maps(self) -> DataFrame:
        """One row per sheet: its declared columns as a map
        ('source:<name>' / 'target:<name>' -> (type, nullable)) and its table
        names.  Bounded by two tables' column lists; replaces three joins of
        the rows with the schema by one join on sheet_id.  Of a repeated
        column the last one counts, as when a document is parsed."""
        entry = F.struct(F.concat(F.col("side"), F.lit(":"), F.col("column_name")).alias("k"), "ordinal",
                         F.struct("type", "nullable").alias("v"), "side", "column_name")
        names = [F.max(F.when(F.col("side") == s, F.col("table_name"))).alias(f"{s}_name") for s in ("source", "target")]
        of_sheet = self.schema.groupBy("sheet_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"), *names)
        last = F.filter("_e", lambda e, i: F.coalesce(F.get("_e", i + 1)["k"] != e["k"], F.lit(True)))
        of_sheet = of_sheet.select("sheet_id", "source_name", "target_name", last.alias("_l"), "_e")
        required = F.array_sort(F.transform(F.filter("_e", lambda e: (e["side"] == "target") & ~e["v"]["nullable"]),
                                            lambda e: F.struct(e["ordinal"].alias("ordinal"), e["column_name"].alias("column_name"))))
        return of_sheet.select("sheet_id", F.map_from_entries(F.transform("_l", lambda e: F.struct(e["k"], e["v"]))).alias("cols"),
                               "source_name", "target_name", required.alias("required"))

    def enriched(self) -> DataFrame:
        """Active rows with their source and target column and the sheet's
        table names (one join keyed by sheet_id, then map lookups)."""
        return self._enriched(self.active()).drop("required")

    def _enriched(self, rows: DataFrame) -> DataFrame:
        e = rows.join(self.schema_maps(), "sheet_id", "left")
        src = F.try_element_at("cols", F.concat(F.lit("source:"), F.col("source_field")))
        tgt = F.try_element_at("cols", F.concat(F.lit("target:"), F.col("target_field")))
        e = e.select(*[c for c in e.columns if c != "cols"], src.alias("_s"), tgt.alias("_t"))
        src_known, tgt_known = F.col("_s").isNotNull(), F.col("_t").isNotNull()
        return e.select(
            *[c for c in e.columns if c not in ("_s", "_t")],
            src_known.alias("src_known"), tgt_known.alias("tgt_known"),
            F.col("_s.type").alias("src_type"), F.col("_t.type").alias("tgt_type"),
            F.col("_t.nullable").alias("tgt_nullable"),
            (src_known & tgt_known).alias("pair"),
            (F.col("_s.nullable") | F.upper(py_strip(F.col("nullable"))).isin(M.SHEET_NULLABLE_VALUES)).alias("src_nullable"),
            (py_strip(F.col("default_value")) != "").alias("has_default"),
            (py_strip(F.col("sql_logic")) != "").alias("has_logic"),
            type_family(F.col("_s.type")).alias("src_family"),
            type_family(F.col("_t.type")).alias("tgt_family"),
        ).withColumn("lossy", lossy_pair(F.col("src_family"), F.col("tgt_family")))

    @staticmethod
    def _row_items() -> Column:
        """The row-level findings of an enriched row as an array: one projection finds them all."""
        pair, null_clash = F.col("pair"), F.col("src_nullable") & ~F.col("tgt_nullable")

        def item(cond, check, sub, sev, msg):
            sev_c = sev if isinstance(sev, Column) else F.lit(sev)
            return F.when(cond, F.struct(F.lit(check).cast("int").alias("check_no"), F.lit(sub).cast("int").alias("sub_no"),
                                         sev_c.alias("severity"), msg.alias("message")))
        items = F.array(
            item((F.col("source_field") != "") & ~F.col("src_known"), M.CHECK_MISSING, 0, "error",
                 _fmt(M.MSG_MISSING_SOURCE, F.col("source_field"),
                      F.coalesce(F.col("source_name"), F.col("source_table")))),
            item((F.col("target_field") != "") & ~F.col("tgt_known"), M.CHECK_MISSING, 1, "error",
                 _fmt(M.MSG_MISSING_TARGET, F.col("target_field"),
                      F.coalesce(F.col("target_name"), F.col("target_table")))),
            item(pair & null_clash & ~F.col("has_default") & ~F.col("has_logic"), M.CHECK_NULL_ERROR, 0, "error",
                 _fmt(M.MSG_NULL_ERROR, F.col("source_field"), F.col("target_field"))),
            item(pair & null_clash & F.col("has_default"), M.CHECK_NULL_INFO, 0, "info",
                 _fmt(M.MSG_NULL_INFO, F.col("source_field"), F.col("target_field"), py_repr(F.col("default_value")))),
            item(pair & (F.col("src_family") != F.col("tgt_family")) & ~F.col("has_logic"), M.CHECK_TYPE, 0,
                 F.when(F.col("lossy"), F.lit("warning")).otherwise(F.lit("info")),
                 _fmt(M.MSG_TYPE, F.col("source_field"), F.col("src_type"), F.col("target_field"), F.col("tgt_type"))),
            item(py_strip(F.col("lookup_table")) != "", M.CHECK_LOOKUP, 0, "warning", _fmt(M.MSG_LOOKUP, F.col("lookup_table"))),
        )
        return F.filter(items, lambda x: x.isNotNull())

    def row_findings(self) -> DataFrame:
        """Every row-level finding of every active row, one explode."""
        row = F.col("row_no")
        found = self.enriched().select("sheet_id", row, F.explode(self._row_items()).alias("f"))
        return found.select(
            F.col("sheet_id").cast("bigint").alias("sheet_id"), F.col("f.check_no").alias("check_no"),
            row.cast("bigint").alias("row_key"), F.col("f.sub_no").alias("sub_no"),
            F.col("f.severity").alias("severity"), row.cast("string").alias("rows"),
            F.col("f.message").alias("message"))

    def _rows_of(self, check: int, sub: int | None = None) -> DataFrame:
        f = self.row_findings().where(F.col("check_no") == check)
        return f if sub is None else f.where(F.col("sub_no") == sub)

    def missing_source_fields(self) -> DataFrame:  # D1, check 6 sub 0
        return self._rows_of(M.CHECK_MISSING, 0)

    def missing_target_fields(self) -> DataFrame:  # D2, check 6 sub 1
        return self._rows_of(M.CHECK_MISSING, 1)

    def field_suggestions(self) -> DataFrame:
        """For every unknown field of an active row (D1, D2): the declared column it most likely means, if one is near.

        Near: at most half of the longer name has to be edited.  The fewest edits win, then the column declared first.
        Rows meet their sheet's columns as one array (one join keyed by sheet), and the distances are taken
        inside the row: no pair leaves it."""
        declared = self.schema.groupBy("sheet_id").agg(F.collect_set(F.struct("side", "ordinal", "column_name")).alias("declared"))
        e = self.enriched()
        sides = F.array(*(F.when((F.col(f"{s}_field") != "") & ~F.col(f"{k}_known"), F.struct(
            F.lit(s).alias("side"), F.col(f"{s}_field").alias("field"))) for s, k in (("source", "src"), ("target", "tgt"))))
        unknown = (e.select("sheet_id", "row_no", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("u"))
                   .select("sheet_id", "row_no", "u.*").join(declared, "sheet_id", "left"))
        near = F.expr("""array_min(filter(
            transform(filter(declared, c -> c.side = side), c -> struct(levenshtein(field, c.column_name) as d, c.ordinal, c.column_name)),
            c -> c.d <= greatest(length(field), length(c.column_name)) div 2))""")
        found = unknown.select("sheet_id", "row_no", "side", "field", near.alias("n"))
        message = F.when(F.col("n").isNotNull(), _fmt(M.MSG_SUGGEST, F.col("field"), F.col("n.column_name")))
        return found.select("sheet_id", "row_no", "side", "field", F.col("n.column_name").alias("suggestion"),
                            F.col("n.d").cast("int").alias("edits"), message.alias("message"))

    def nullability_conflicts(self) -> DataFrame:  # D4, checks 9 (error) and 2 (info)
        return self.row_findings().where(F.col("check_no").isin(M.CHECK_NULL_ERROR, M.CHECK_NULL_INFO))

    def type_conflicts(self) -> DataFrame:  # D5, check 3
        return self._rows_of(M.CHECK_TYPE)

    def lookup_reference_findings(self) -> DataFrame:  # C7, check 4
        return self._rows_of(M.CHECK_LOOKUP)

    def family_pairs(self) -> DataFrame:  # B18 + B19 per active row with both fields known
        return self.enriched().where("pair").select("sheet_id", "row_no", "source_field", "target_field",
                                                    "src_type", "tgt_type", "src_family", "tgt_family",
                                                    "has_logic", "lossy")

    def duplicate_targets(self) -> DataFrame:  # F1, check 7
        a = self.active().select("sheet_id", "row_no", "target_field")
        lagged = lag_in_group(a, ["sheet_id", "target_field"], "row_no", "prev_row", self.bucket_size, dense=True)
        d = lagged.where(F.col("prev_row").isNotNull())
        return _finding(d, M.CHECK_DUPLICATE, F.col("row_no"), 0, "error",
                        F.concat_ws(", ", F.col("prev_row").cast("string"), F.col("row_no").cast("string")),
                        _fmt(M.MSG_DUPLICATE, F.col("target_field")))

    def unmapped_required_targets(self) -> DataFrame:  # D3, check 8
        sheets_with_active = self.sheet_summary().where(F.col("n_active") > 0).select("sheet_id")
        req = self.required_columns().join(sheets_with_active, "sheet_id", "left_semi")
        mapped = self.mapped_targets().withColumnRenamed("target_field", "column_name")
        un = req.join(mapped, ["sheet_id", "column_name"], "left_anti")
        return _finding(un, M.CHECK_UNMAPPED, F.col("ordinal"), 0, "error", F.lit("-"),
                        _fmt(M.MSG_UNMAPPED, F.col("column_name")))

    # ---- H1 / E2 / E8 ----------------------------------------------------------
    def _bucket_records(self) -> DataFrame:
        """(sheet_id, kind, target_field, at, findings, bound, sums) from one read of the rows and one of the schemas.

        Rows are dealt once, by (sheet, row bucket), and each bucket becomes: its finished findings (kind F: those of single
        rows, and of targets repeated within the bucket), one bound per target (kind T: first and last row, for repeats
        across buckets), and its sums (kind S: counts, excluded row numbers, required targets that are mapped)."""
        none = f"cast(array() as array<{_MADE}>)"
        e = self._enriched(self.rows).select("sheet_id", "row_no", "active", F.col("target_field").alias("t"), "required",
                                             self._row_items().alias("items"))
        # one struct as key: a hot sheet is dealt by its buckets even where the join has dealt by sheet
        dealt = e.selectExpr(
            f"struct(sheet_id, cast(floor(row_no / {self.bucket_size}) as bigint) as at) as _g", "required",
            f"struct(row_no, active, t, if(active, transform(items, x -> {_made('x.check_no', 'row_no', 'x.sub_no', 'x.severity', 'row_no', 'x.message')}), "
            f"{none}) as found) as _r").groupBy("_g").agg(
            F.expr("any_value(required, true) as required"), F.expr("array_sort(collect_list(_r)) as _r"))
        dealt = dealt.selectExpr("_g.*", "required", "_r",
                                 "array_sort(transform(filter(_r, r -> r.active), r -> struct(r.t as t, r.row_no as n))) as _t")
        parts = dealt.selectExpr(
            "sheet_id", "at", "required", "cast(size(_t) as bigint) as n_active",
            f"concat(flatten(transform(_r, r -> r.found)), filter(transform(_t, (x, i) -> if(get(_t, i - 1).t = x.t, "
            f"{_repeat('x.t', 'get(_t, i - 1).n', 'x.n')}, null)), x -> x is not null)) as done",
            "zip_with(filter(_t, (x, i) -> coalesce(get(_t, i - 1).t != x.t, true)), filter(_t, (x, i) -> coalesce(get(_t, i + 1).t != x.t, true)), "
            "(a, z) -> struct(a.t as t, a.n as first, z.n as last)) as bounds",
            "transform(filter(_r, r -> not r.active), r -> cast(r.row_no as string)) as excluded")

        def record(kind: str, **given: str) -> str:
            fields = (("t", "string"), ("spread", "bigint"), ("done", f"array<{_MADE}>"), ("bound", _BOUND), ("sums", _SUMS))
            return f"struct('{kind}' as kind, " + ", ".join(f"cast({given.get(c, 'null')} as {t}) as {c}" for c, t in fields) + ")"
        sums = ("struct(at, n_active, cast(size(excluded) as bigint), array_join(excluded, ', '), array_intersect(transform(required, "
                "r -> r.column_name), transform(bounds, b -> b.t)), required)")
        return parts.selectExpr("sheet_id", "explode(concat(array(" + record("F", spread="at", done="done") + ", " + record("S", sums=sums)
                                + "), transform(bounds, b -> " + record("T", t="b.t", bound="struct(at, b.first, b.last)") + "))) as x"
                                ).select("sheet_id", "x.*")

    def _flow(self) -> DataFrame:
        """All findings of all sheets, and for every sheet one row without a check (so that sheets without findings
        are seen too).  The buckets' records meet per sheet and per (sheet, target); finished findings pass in whole arrays."""
        met = self._bucket_records().groupBy(F.expr("struct(sheet_id, kind, t, spread)").alias("_k")).agg(*map(F.expr, (
            "any_value(done, true) as done", "array_sort(collect_list(bound)) as bounds",
            "sum(sums.n_active) as n_active", "sum(sums.n_excluded) as n_excluded",
            "array_sort(collect_list(if(sums.excluded != '', struct(sums.at, sums.excluded), null))) as excluded",
            "array_distinct(flatten(collect_list(sums.mapped))) as mapped", "any_value(sums.required, true) as required")))
        excluded = _made(M.CHECK_EXCLUDED, 0, 0, "'info'", "array_join(transform(excluded, x -> x.excluded), ', ')",
                         _said(M.MSG_EXCLUDED, "n_excluded"))
        no_active = _made(M.CHECK_NO_ACTIVE, 0, 0, "'error'", "'-'", _said(M.MSG_NO_ACTIVE))
        unmapped = _made(M.CHECK_UNMAPPED, "r.ordinal", 0, "'error'", "'-'", _said(M.MSG_UNMAPPED, "r.column_name"))
        across = _repeat("_k.t", "get(bounds, i - 1).last", "b.first")
        flat = met.selectExpr("cast(_k.sheet_id as bigint) as sheet_id", f"""explode(case _k.kind
            when 'F' then done
            when 'T' then filter(transform(bounds, (b, i) -> if(i > 0, {across}, null)), x -> x is not null)
            else concat(
                array(cast(null as {_MADE})),
                filter(array(if(n_excluded > 0, {excluded}, null), if(n_active = 0, {no_active}, null)), x -> x is not null),
                coalesce(transform(filter(required, r -> n_active > 0 and not array_contains(mapped, r.column_name)), r -> {unmapped}),
                         array()))
            end) as f""")
        return flat.select("sheet_id", "f.*")

    def all_findings(self) -> DataFrame:
        return self._flow().where(F.col("check_no").isNotNull())

    def _with_sheets(self, findings: DataFrame | None) -> DataFrame:
        """Findings and, for every sheet, a row without one."""
        if findings is None:
            return self._flow()
        return findings.unionByName(self.sheet_summary().select("sheet_id"), allowMissingColumns=True)

    def loadable_sheets(self, findings: DataFrame | None = None) -> DataFrame:
        """Sheets with no error finding: the ones that go on to compile and load."""
        errors = F.count_if(F.col("severity") == "error")
        return self._with_sheets(findings).groupBy("sheet_id").agg(errors.alias("n")).where("n = 0").select("sheet_id")

    def finding_counts(self, findings: DataFrame | None = None) -> DataFrame:
        severity = F.col("severity")
        return self._with_sheets(findings).groupBy("sheet_id").agg(
            *(F.count_if(severity == s).cast("bigint").alias(n) for s, n in (("error", "n_errors"), ("warning", "n_warnings"), ("info", "n_infos"))))

    def finding_notes(self, findings: DataFrame | None = None) -> DataFrame:
        f = self._with_sheets(findings).where(F.col("severity").isNull() | (F.col("severity") != "error"))
        line = F.concat(F.lit("- row "), F.col("rows"), F.lit(": "), F.col("message"))
        notes = ordered_string_agg(f, ["sheet_id"], ["check_no", "row_key", "sub_no"], line, "\n", "notes",
                                   bucket_col="row_key", bucket_size=self.bucket_size)
        return notes.select("sheet_id", F.when(F.col("notes") != "", F.col("notes")).otherwise("none").alias("notes"))


_FINDING = (("check_no", "int"), ("row_key", "bigint"), ("sub_no", "int"), ("severity", "string"), ("rows", "string"), ("message", "string"))
_MADE = "struct<" + ", ".join(f"{n}: {t}" for n, t in _FINDING) + ">"
_BOUND = "struct<at: bigint, first: bigint, last: bigint>"
_SUMS = ("struct<at: bigint, n_active: bigint, n_excluded: bigint, excluded: string, mapped: array<string>, "
         "required: array<struct<ordinal: int, column_name: string>>>")


# The flow's expressions are SQL text: a plan of some hundred expressions is built by a few calls.
def _made(*values) -> str:
    """A finding as a SQL struct, from SQL expressions in the order of _FINDING."""
    return "struct(" + ", ".join(f"cast({v} as {t}) as {n}" for v, (n, t) in zip(values, _FINDING)) + ")"


def _said(template: str, *exprs: str) -> str:
    """`_fmt` as SQL."""
    first, *rest = ("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in template.split("{}"))
    return "concat(" + ", ".join([first, *(x for e, p in zip(exprs, rest) for x in (f"cast({e} as string)", p))]) + ")"


def _repeat(target: str, prev: str, row: str) -> str:
    return _made(M.CHECK_DUPLICATE, row, 0, "'error'", f"concat({prev}, ', ', {row})", _said(M.MSG_DUPLICATE, target))


def schema_drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Declared source columns absent from the live table, named in
    declared order; one error row per table with drift."""
    miss = declared.join(live.select("sheet_id", "column_name"), ["sheet_id", "column_name"], "left_anti")
    names = ordered_string_agg(miss, ["sheet_id", "table_name"], ["ordinal"], F.col("column_name"), ", ",
                               "missing_columns")
    return names.select("sheet_id", "table_name", "missing_columns",
                        _fmt(M.MSG_DRIFT, F.col("table_name"), F.col("missing_columns")).alias("message"))
