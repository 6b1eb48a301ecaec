"""The mapping run as one call: validate -> compile (analysis is the dry
run) -> load a new version -> audit -> make it current.

Each step is a Spark job over DataFrames; the driver only holds the one
sheet being compiled (a bounded upload) and one audit row.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.functions.rules import declared_value, length_limit, spark_type_name
from maplift.model import MAPPING_COLUMNS
from maplift.operators import audit, load
from maplift.operators.validate import Validator
from maplift.plans.compile import ColumnSpec, MappingError, apply_mapping, compile_mapping, sheet_rows_of
from maplift.session import fresh_path


@dataclass
class RunResult:
    status: str                      # succeeded | failed
    findings: list[dict] = field(default_factory=list)
    audit: dict | None = None
    version: str | None = None
    failed_step: str | None = None


def _specs(schema_cols: DataFrame, side: str) -> dict[str, ColumnSpec]:
    rows = (schema_cols.where(F.col("side") == side).orderBy("ordinal")
            .select("column_name", "type", "nullable").collect())
    return {r.column_name: ColumnSpec(r.type, bool(r.nullable)) for r in rows}


def _declared_type(spec: ColumnSpec) -> str:
    return spec.type if length_limit(spec.type) else spark_type_name(spec.type)


def _declared(mapped: DataFrame, tgt_spec: dict[str, ColumnSpec]) -> DataFrame:
    """Insert columns are the active rows' target fields in sheet order;
    A9: values cast to the declared target types."""
    fields = list(mapped.columns)
    declared = {f: _declared_type(tgt_spec[f]) if f in tgt_spec else mapped.schema[f].dataType
                for f in fields}
    return load.conform(load.to_target_columns(mapped, fields), declared)


def _compile_failure(found: list[dict], e: MappingError) -> RunResult:
    """An unknown rule, or logic that is not covered, is an error of its row."""
    row, _, message = str(e).partition(": ")
    found.append({"severity": "error", "rows": row.removeprefix("row "), "message": message or str(e)})
    return RunResult("failed", found, failed_step="compile")


def _load(mapped: DataFrame, expected: DataFrame, tgt_spec: dict[str, ColumnSpec], target_root: str, found: list[dict],
          full_refresh: bool) -> RunResult:
    """Load a compiled sheet's rows and audit them against `expected` before they are committed."""
    required = [n for n, c in tgt_spec.items() if not c.nullable and n in mapped.columns]
    result: dict = {}

    def check(written: DataFrame) -> None:
        a = audit.load_audit(expected, written, required).collect()[0].asDict()
        result.update(a)
        if not a["ok"]:
            raise load.LoadError(a["failed_check"])

    try:
        if full_refresh:
            version = load.full_refresh_load(mapped, target_root, check, stats=result)
        else:
            version = load.append_load(mapped, target_root, check, stats=result)
    except load.LoadError:
        return RunResult("failed", found, result, None, "audit")
    return RunResult("succeeded", found, result, version)


def run_mapping(sheet: DataFrame, schema_cols: DataFrame, source: DataFrame, target_root: str,
                load_ts: str | None = None, full_refresh: bool = True) -> RunResult:
    """Run one sheet (`sheet_id` rows of `mapping_rows`) end to end."""
    rows = sheet_rows_of(sheet)  # one sheet, or an error before anything is collected
    v = Validator(sheet, schema_cols)
    found = [r.asDict() for r in v.all_findings().orderBy("check_no", "row_key", "sub_no").collect()]
    if any(f["severity"] == "error" for f in found):
        return RunResult("failed", found, failed_step="validate")
    src_spec, tgt_spec = _specs(schema_cols, "source"), _specs(schema_cols, "target")
    try:
        mapped = _declared(apply_mapping(source, rows, src_spec, tgt_spec, load_ts), tgt_spec)
    except MappingError as e:
        return _compile_failure(found, e)
    return _load(mapped, source, tgt_spec, target_root, found, full_refresh)


def run_mappings(sheets: DataFrame, schema_cols: DataFrame, source: DataFrame, target_roots: dict[int, str],
                 load_ts: str | None = None, full_refresh: bool = True) -> dict[int, RunResult]:
    """Run the sheets of `target_roots` (sheet id -> target), which all map one source table, with one read of it.

    All sheets are validated in one job.  Those without an error are compiled, and the source is read once:
    each row is written with one struct per sheet, and each target is loaded from its own struct (the other
    sheets' columns are not read again), audited and committed by itself, so one sheet's failed audit does not touch
    the others.  A value that makes one sheet's logic fail would fail the shared read; the sheets then run
    one by one, and the failing one ends as `execute`.  The driver holds the sheets being compiled: bounded uploads."""
    spark = source.sparkSession
    mine = F.col("sheet_id").isin(list(target_roots))
    sheets, schema_cols = sheets.where(mine), schema_cols.where(mine)
    rows: dict[int, list[dict]] = {i: [] for i in target_roots}
    for r in sheets.select("sheet_id", "row_no", *MAPPING_COLUMNS).collect():
        rows[r.sheet_id].append(r.asDict())
    found: dict[int, list[dict]] = {i: [] for i in target_roots}
    for r in Validator(sheets, schema_cols).all_findings().orderBy("sheet_id", "check_no", "row_key", "sub_no").collect():
        found[r.sheet_id].append(r.asDict())
    specs: dict[int, dict[str, dict[str, ColumnSpec]]] = {i: {"source": {}, "target": {}} for i in target_roots}
    for r in schema_cols.orderBy("ordinal").select("sheet_id", "side", "column_name", "type", "nullable").collect():
        specs[r.sheet_id][r.side][r.column_name] = ColumnSpec(r.type, bool(r.nullable))
    results, compiled = {}, {}
    for i in target_roots:
        if not rows[i]:
            results[i] = RunResult("failed", [{"severity": "error", "rows": "-", "message": f"no mapping rows of sheet {i}"}],
                                   failed_step="validate")
        elif any(f["severity"] == "error" for f in found[i]):
            results[i] = RunResult("failed", found[i], failed_step="validate")
        else:
            try:
                compiled[i] = _declared_columns(source, rows[i], specs[i], load_ts)
            except MappingError as e:
                results[i] = _compile_failure(found[i], e)
    if not compiled:
        return results
    staged = fresh_path(spark, "shared_read")
    try:
        source.select(*(F.struct(*cols).alias(f"s{i}") for i, cols in compiled.items())).write.parquet(staged)
        shared = spark.read.parquet(staged)
        for i in compiled:
            results[i] = _load(shared.select(f"s{i}.*"), shared, specs[i]["target"], target_roots[i], found[i], full_refresh)
    except PySparkException:
        for i, cols in compiled.items():
            try:
                results[i] = results.get(i) or _load(source.select(*cols), source, specs[i]["target"], target_roots[i], found[i], full_refresh)
            except PySparkException as e:
                found[i].append({"severity": "error", "rows": "-", "message": str(e).split("\n")[0]})
                results[i] = RunResult("failed", found[i], failed_step="execute")
    return results


def _declared_columns(source: DataFrame, rows: list[dict], spec: dict[str, dict[str, ColumnSpec]], load_ts: str | None) -> list[Column]:
    """The compiled columns of a sheet, cast to the declared target types (as `_declared` does to a DataFrame)."""
    out = []
    for c in compile_mapping(source, rows, spec["source"], spec["target"], load_ts):
        name = source.select(c).columns[0]
        out.append((declared_value(c, _declared_type(spec["target"][name]), name) if name in spec["target"] else c).alias(name))
    return out


# Step index per outcome (0-based, 8 steps): validation is step 1, the
# audit step 7 (see the run step states, I3).
_STEP_OF = {"validate": 1, "compile": 3, "execute": 6, "audit": 7}

RUN_ROW_SCHEMA = ("run_id string, target_table string, status string, current_step int, step_failed boolean, "
                  "started_at bigint, duration_sec bigint, mappings_validated int, mappings_excluded int, "
                  "audit_rows_written bigint, audit_counts_match boolean, audit_nulls_check boolean, "
                  "audit_failed_check string")


def record_run(spark, runs_root: str, feed_root: str, run_id: str, target_table: str, result: RunResult,
               started_at_ms: int, finished_at_ms: int, n_active: int, n_excluded: int) -> None:
    """Append the run's row to `runs` and its findings to `run_feed` (both
    versioned tables; one new folder each, no rewrite of earlier runs)."""
    from maplift.operators.load import append_load
    a = result.audit or {}
    failed = result.status != "succeeded"
    row = (run_id, target_table, result.status,
           _STEP_OF.get(result.failed_step, 7), failed, started_at_ms,
           max(0, (finished_at_ms - started_at_ms) // 1000), n_active, n_excluded,
           a.get("rows_written"), a.get("counts_match"), (a.get("null_violations") == 0) if a else None,
           a.get("failed_check"))
    append_load(spark.createDataFrame([row], RUN_ROW_SCHEMA), runs_root)
    kinds = {"error": "tool_error", "warning": "tool_result", "info": "tool_result"}
    entries = [(run_id, i, kinds.get(f["severity"], "thought"), f'row {f["rows"]}: {f["message"]}')
               for i, f in enumerate(result.findings)]
    if entries:
        append_load(spark.createDataFrame(entries, "run_id string, seq bigint, kind string, text string"), feed_root)
