"""Queries: loads and audits."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.model import MAPPING_ROWS_SCHEMA
from maplift.operators import audit, load
from maplift.plans.mapping import mapped_patients, sample_schema_columns
from maplift.plans.registry import query
from maplift.plans.workflow import run_mappings
from maplift.session import fresh_path
from maplift.sources import derived
from maplift.sources.samples import DEFAULT_LOAD_TS, sample_sheet_records
from maplift.sources.tables import read_table


@query("load_audit")
def q_load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.load_audit(read_table(spark, sf_dir, "orders"), derived.audit_target(spark, sf_dir),
                            derived.AUDIT_REQUIRED)


@query("null_violations")
def q_null_violations(spark, sf_dir):
    return audit.null_violations(derived.audit_target(spark, sf_dir), derived.AUDIT_REQUIRED)


@query("null_rows")
def q_null_rows(spark, sf_dir):
    return audit.null_rows(derived.audit_target(spark, sf_dir), derived.AUDIT_REQUIRED)


@query("volume_estimate")
def q_volume_estimate(spark, sf_dir):
    return audit.volume_estimate(mapped_patients(spark, sf_dir))


def _part_halves(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    part = read_table(spark, sf_dir, "part")
    root = fresh_path(spark, "tables/part_copy")
    return root, part.where(F.col("p_partkey") % 2 == 0), part.where(F.col("p_partkey") % 2 == 1)


def _audited(source: DataFrame, required: list[str]):
    """A load check: E3 on the staged version; a failure keeps the old one."""
    def check(written: DataFrame) -> None:
        a = audit.load_audit(source, written, required).first()
        if not a["ok"]:
            raise load.LoadError(a["failed_check"])
    return check


@query("full_refresh_load")
def q_full_refresh(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    root = fresh_path(spark, "tables/part_copy")
    load.full_refresh_load(part, root, _audited(part, ["p_partkey", "p_name"]))
    return load.read_current(spark, root)


@query("append_load")
def q_append(spark, sf_dir):
    root, even, odd = _part_halves(spark, sf_dir)
    load.append_load(even, root, _audited(even, ["p_partkey"]))
    load.append_load(odd, root, _audited(odd, ["p_partkey"]))
    return load.read_current(spark, root)


@query("row_count")
def q_row_count(spark, sf_dir):
    root, even, odd = _part_halves(spark, sf_dir)
    load.full_refresh_load(even, root)
    load.append_load(odd, root)
    return audit.row_count(load.read_current(spark, root))


@query("scd1_upsert")
def q_scd1(spark, sf_dir):
    root = fresh_path(spark, "tables/customer_scd1")
    load.full_refresh_load(derived.scd1_target_before(spark, sf_dir), root)
    load.scd1_upsert(spark, root, derived.scd1_source(spark, sf_dir), ["c_custkey"], "version")
    return load.read_current(spark, root)


#: Three sheets over one source: the sample's rows (by row number) that each maps.
SHARED_SHEETS = {0: range(2, 10), 1: (2, 4, 9), 2: (2, 6, 7, 9)}


@query("shared_source_load")
def q_shared_source_load(spark, sf_dir):
    """Three sheets over `patients` loaded with one read of it; a value of each loaded table."""
    rows = [dict(r, sheet_id=i) for i, kept in SHARED_SHEETS.items() for r in sample_sheet_records() if r["row_no"] in kept]
    sheets = spark.createDataFrame([tuple(r[f.name] for f in MAPPING_ROWS_SCHEMA.fields) for r in rows], MAPPING_ROWS_SCHEMA)
    roots = {i: fresh_path(spark, f"tables/shared_{i}") for i in SHARED_SHEETS}
    results = run_mappings(sheets, sample_schema_columns(spark, list(SHARED_SHEETS)), derived.patients(spark, sf_dir), roots, DEFAULT_LOAD_TS)
    out = []
    for i, col in ((0, "full_name"), (1, "email_address"), (2, "weight")):
        if results[i].status != "succeeded":
            raise load.LoadError(f"sheet {i}: {results[i]}")
        out.append(load.read_current(spark, roots[i]).select(F.lit(i).alias("sheet_id"), "patient_id", F.col(col).cast("string").alias("value")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("fact_incremental")
def q_fact_incremental(spark, sf_dir):
    return load.fact_incremental(read_table(spark, sf_dir, "events"), derived.fact_target_before(spark, sf_dir),
                                 "ts", ["event_id"], "2 days")


@query("incremental_filter")
def q_incremental_filter(spark, sf_dir):
    return load.incremental_filter(read_table(spark, sf_dir, "events"), derived.fact_target_before(spark, sf_dir),
                                   "ts", "ts")


@query("partition_replace")
def q_partition_replace(spark, sf_dir):
    """The days of even number are loaded again, with their values doubled."""
    events = read_table(spark, sf_dir, "events")
    root = fresh_path(spark, "tables/events_replaced")
    load.partitioned_load(events, root, "ts", "dt")
    again = events.where(F.dayofmonth("ts") % 2 == 0).withColumn("value", F.col("value") * 2)
    load.replace_partitions(again, root, "ts", "dt")
    return load.read_current(spark, root)


@query("partitioned_load")
def q_partitioned_load(spark, sf_dir):
    root = fresh_path(spark, "tables/events_by_day")
    load.partitioned_load(read_table(spark, sf_dir, "events"), root, "ts", "dt")
    return load.read_current(spark, root)
