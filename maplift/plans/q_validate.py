"""Queries: mapping-catalog validation over all sheets (C1, C6, C7, D1-D6,
E1, E2, E7, E8, F1, H1, H2, B18, B19)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.model import MAPPING_COLUMNS
from maplift.operators.validate import Validator, schema_drift
from maplift.plans.registry import query
from maplift.sources import derived


def validator(spark: SparkSession, sf_dir: str) -> Validator:
    rows = derived.mapping_rows(spark, sf_dir)
    return Validator(rows, derived.schema_columns(spark, sf_dir, rows))


@query("active_mappings")
def q_active(spark, sf_dir) -> DataFrame:
    return validator(spark, sf_dir).active().select("sheet_id", "row_no", *MAPPING_COLUMNS)


@query("excluded_mappings")
def q_excluded(spark, sf_dir) -> DataFrame:
    return validator(spark, sf_dir).excluded().select("sheet_id", "row_no", *MAPPING_COLUMNS)


@query("mapping_counts")
def q_mapping_counts(spark, sf_dir):
    return validator(spark, sf_dir).mapping_counts()


@query("required_columns")
def q_required_columns(spark, sf_dir):
    return validator(spark, sf_dir).required_columns()


@query("lookup_reference_findings")
def q_lookup_reference_findings(spark, sf_dir):
    return validator(spark, sf_dir).lookup_reference_findings()


@query("missing_source_fields")
def q_missing_source(spark, sf_dir):
    return validator(spark, sf_dir).missing_source_fields()


@query("missing_target_fields")
def q_missing_target(spark, sf_dir):
    return validator(spark, sf_dir).missing_target_fields()


@query("field_suggestions")
def q_field_suggestions(spark, sf_dir):
    return validator(spark, sf_dir).field_suggestions()


@query("unmapped_required_targets")
def q_unmapped(spark, sf_dir):
    return validator(spark, sf_dir).unmapped_required_targets()


@query("nullability_conflicts")
def q_nullability(spark, sf_dir):
    return validator(spark, sf_dir).nullability_conflicts()


@query("type_conflicts")
def q_type_conflicts(spark, sf_dir):
    return validator(spark, sf_dir).type_conflicts()


@query("schema_drift")
def q_schema_drift(spark, sf_dir):
    cols = derived.schema_columns(spark, sf_dir)
    declared = cols.where(F.col("side") == "source")
    return schema_drift(declared, derived.live_source_columns(cols))


@query("duplicate_targets")
def q_duplicate_targets(spark, sf_dir):
    return validator(spark, sf_dir).duplicate_targets()


@query("excluded_rows_finding")
def q_excluded_rows_finding(spark, sf_dir):
    return validator(spark, sf_dir).excluded_rows_finding()


@query("all_findings")
def q_all_findings(spark, sf_dir):
    return validator(spark, sf_dir).all_findings()


@query("finding_counts")
def q_finding_counts(spark, sf_dir):
    return validator(spark, sf_dir).finding_counts()


@query("finding_notes")
def q_finding_notes(spark, sf_dir):
    return validator(spark, sf_dir).finding_notes()


@query("mapped_targets")
def q_mapped_targets(spark, sf_dir):
    return validator(spark, sf_dir).mapped_targets()


@query("type_family")
def q_type_family(spark, sf_dir):
    from maplift.functions.types import type_family
    cols = derived.schema_columns(spark, sf_dir)
    return cols.select("sheet_id", "side", "column_name", "type", type_family(F.col("type")).alias("family"))


@query("lossy_pair")
def q_lossy_pair(spark, sf_dir):
    return validator(spark, sf_dir).family_pairs().select("sheet_id", "row_no", "src_family", "tgt_family", "lossy")
