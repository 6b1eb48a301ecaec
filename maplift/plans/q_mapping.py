"""Queries: the mapping applied (B0) and each rule alone."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.functions import rules
from maplift.operators.lookup import lookup_join
from maplift.plans.compile import ColumnSpec, apply_mapping
from maplift.plans.mapping import mapped_patients
from maplift.plans.registry import query
from maplift.sources import derived
from maplift.sources.samples import DEFAULT_LOAD_TS


@query("apply_mapping")
def q_apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_patients(spark, sf_dir)


def _rule(spark: SparkSession, sf_dir: str, col) -> DataFrame:
    return derived.patients(spark, sf_dir).select("patient_id", col.alias("value"))


@query("rule_copy")
def q_rule_copy(spark, sf_dir):
    return _rule(spark, sf_dir, rules.copy("primary_provider_id"))


@query("rule_concat_space")
def q_rule_concat_space(spark, sf_dir):
    return _rule(spark, sf_dir, rules.concat_space("first_name", "last_name"))


@query("rule_clean_email")
def q_rule_clean_email(spark, sf_dir):
    return _rule(spark, sf_dir, rules.clean_email("cust_email_01"))


@query("rule_iso_date")
def q_rule_iso_date(spark, sf_dir):
    return _rule(spark, sf_dir, rules.iso_date("dob"))


@query("rule_round_int")
def q_rule_round_int(spark, sf_dir):
    return _rule(spark, sf_dir, rules.round_int("weight_kg"))


SITE_CITIES = {"01": "Chennai", "02": "Mumbai", "03": "Delhi"}


@query("rule_code_case")
def q_rule_code_case(spark, sf_dir):
    return _rule(spark, sf_dir, rules.code_case("site_code", SITE_CITIES, "Unknown"))


@query("rule_flag_bool")
def q_rule_flag_bool(spark, sf_dir):
    return _rule(spark, sf_dir, rules.flag_bool("enrolled_flag", "Y"))


@query("rule_load_time")
def q_rule_load_time(spark, sf_dir):
    return _rule(spark, sf_dir, rules.load_time(DEFAULT_LOAD_TS))


@query("rule_default")
def q_rule_default(spark, sf_dir):
    return _rule(spark, sf_dir, rules.with_default("primary_provider_id", "'PR-UNASSIGNED'"))


@query("rule_type_cast")
def q_rule_type_cast(spark, sf_dir):
    # FLOAT -> INTEGER without logic: cast through half-even rounding
    return _rule(spark, sf_dir, rules.type_cast("weight_kg", "INTEGER", "float"))


@query("rule_safe_cast")
def q_rule_safe_cast(spark, sf_dir):
    return _rule(spark, sf_dir, rules.safe_cast("risk_score", "INTEGER"))


@query("rule_title_case")
def q_rule_title_case(spark, sf_dir):
    return _rule(spark, sf_dir, rules.title_case("raw_note"))


@query("rule_unit_convert")
def q_rule_unit_convert(spark, sf_dir):
    return _rule(spark, sf_dir, rules.unit_convert("height_cm", 2.54, 1))


@query("rule_parse_date_fmt")
def q_rule_parse_date_fmt(spark, sf_dir):
    return _rule(spark, sf_dir, rules.parse_date_fmt("dob", "yyyy-MM-dd"))


@query("rule_utc_timestamp")
def q_rule_utc_timestamp(spark, sf_dir):
    return _rule(spark, sf_dir, rules.utc_timestamp("admitted_at"))


@query("rule_clean_string")
def q_rule_clean_string(spark, sf_dir):
    return _rule(spark, sf_dir, rules.clean_string("raw_note"))


@query("lookup_join")
def q_lookup_join(spark, sf_dir):
    p = derived.patients(spark, sf_dir).select("patient_id", "nation_key")
    return lookup_join(p, derived.nation_lookup(spark, sf_dir), "nation_key", "nation_name", "Unknown")


@query("row_filter")
def q_row_filter(spark, sf_dir):
    src = derived.patients(spark, sf_dir).where(F.col("record_status") == "ACTIVE")
    return mapped_patients(spark, sf_dir, source_df=src)


@query("target_preview")
def q_target_preview(spark, sf_dir):
    cols = ["patient_id", "full_name", "email_address", "date_of_birth", "weight", "site_city", "is_enrolled"]
    return mapped_patients(spark, sf_dir).select(*cols).orderBy("patient_id").limit(10)


# One sheet that calls every named rule, and SQL logic with the shapes that differ from Postgres:
# (source field, transformation rule, SQL logic, default, target field, target type)
RULE_SHEET = [
    ("primary_provider_id", "Copy as-is", "", "", "r_copy", "VARCHAR"),
    ("first_name", "concat_space(last_name)", "", "", "r_concat", "VARCHAR"),
    ("cust_email_01", "cleanEmail(cust_email_01)", "", "", "r_email", "VARCHAR"),
    ("dob", "iso_date", "", "", "r_date", "DATE"),
    ("weight_kg", "Round to nearest integer", "", "", "r_round", "INTEGER"),
    ("site_code", "siteLookup(site_code)", "", "", "r_site", "VARCHAR"),
    ("site_code", "code_case('01', 'one', '02', 'it''s two', 'more')", "", "", "r_case", "VARCHAR"),
    ("enrolled_flag", "flag_bool('N')", "", "", "r_flag", "BOOLEAN"),
    ("created_at", "Stamp load time", "", "", "r_time", "TIMESTAMP"),
    ("primary_provider_id", "", "", "PR-NONE", "r_default", "VARCHAR"),
    ("weight_kg", "", "", "", "r_cast", "INTEGER"),
    ("risk_score", "safe_cast", "", "", "r_safe", "INTEGER"),
    ("raw_note", "title_case", "", "", "r_title", "VARCHAR"),
    ("height_cm", "unit_convert(2.54, 1)", "", "", "r_unit", "DOUBLE"),
    ("dob", "parse_date_fmt(dob, 'yyyy-MM-dd')", "", "", "r_parsed", "DATE"),
    ("admitted_at", "utc_timestamp", "", "", "r_utc", "TIMESTAMP"),
    ("raw_note", "clean_string()", "", "", "r_clean", "VARCHAR"),
    ("weight_kg", "", "ROUND(COALESCE(weight_kg, 0))", "", "s_round", "DOUBLE"),
    ("weight_kg", "", "CAST(weight_kg AS INTEGER)", "", "s_cast", "INTEGER"),
    ("weight_kg", "", "CAST(ROUND(CAST(weight_kg AS NUMERIC(10,2))) AS INTEGER)", "", "s_numeric", "INTEGER"),
    ("site_code", "", "CONCAT('round(select)', \"site_code\", NULL)", "", "s_concat", "VARCHAR"),
    ("created_at", "", "CURRENT_TIMESTAMP", "", "s_time", "TIMESTAMP"),
]


@query("apply_mapping_rules")
def q_apply_mapping_rules(spark, sf_dir):
    """B0 over a sheet with one row per named rule (B1-B16) and per SQL shape."""
    rows = [{"row_no": i + 2, "source_field": sf, "transformation_rule": rule, "sql_logic": sql, "default_value": default,
             "target_field": tf, "target_type": typ, "nullable": "YES", "mapping_status": "Validated"}
            for i, (sf, rule, sql, default, tf, typ) in enumerate([("patient_id", "copy", "", "", "patient_id", "VARCHAR"), *RULE_SHEET])]
    target = {r["target_field"]: ColumnSpec(r["target_type"], not r["default_value"]) for r in rows}
    source = {"weight_kg": ColumnSpec("FLOAT", True)}
    return apply_mapping(derived.patients(spark, sf_dir), rows, source, target, DEFAULT_LOAD_TS)
