"""The sample mapping applied to `patients` (flagship) and its pieces."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.plans.compile import ColumnSpec, apply_mapping
from maplift.sources import derived
from maplift.sources.samples import (DEFAULT_LOAD_TS, SAMPLE_SOURCE_SCHEMA_MD, SAMPLE_TARGET_SCHEMA_MD,
                                     sample_sheet_records)
from maplift.sources.schema_doc import parse_schema_docs


@lru_cache(maxsize=8)
def sample_schemas(spark: SparkSession) -> tuple[dict[str, ColumnSpec], dict[str, ColumnSpec]]:
    """The two sample documents parsed by the A1 job (once per session)."""
    docs = spark.createDataFrame([("source", SAMPLE_SOURCE_SCHEMA_MD), ("target", SAMPLE_TARGET_SCHEMA_MD)],
                                 "doc_id string, text string")
    rows = parse_schema_docs(docs).orderBy("doc_id", "ordinal").collect()  # two documents' columns
    specs: dict[str, dict[str, ColumnSpec]] = {"source": {}, "target": {}}
    for r in rows:
        specs[r["doc_id"]][r["column_name"]] = ColumnSpec(r["type"], bool(r["nullable"]))
    return specs["source"], specs["target"]


def sample_schema_columns(spark: SparkSession, sheet_ids: list[int]) -> DataFrame:
    """The columns of the two sample documents as the declared schema of every sheet of `sheet_ids`."""
    docs = spark.createDataFrame([("source", SAMPLE_SOURCE_SCHEMA_MD), ("target", SAMPLE_TARGET_SCHEMA_MD)],
                                 "doc_id string, text string")
    ids = F.explode(F.array(*[F.lit(i).cast("bigint") for i in sheet_ids])).alias("sheet_id")
    return parse_schema_docs(docs).select(ids, F.col("doc_id").alias("side"), "table_name", "ordinal", "column_name", "type", "nullable",
                                          "description")


def mapped_patients(spark: SparkSession, sf_dir: str, load_ts: str = DEFAULT_LOAD_TS,
                    source_df: DataFrame | None = None) -> DataFrame:
    src_spec, tgt_spec = sample_schemas(spark)
    rows = sample_sheet_records()
    src = source_df if source_df is not None else derived.patients(spark, sf_dir)
    return apply_mapping(src, rows, src_spec, tgt_spec, load_ts)


def target_required(spark: SparkSession) -> list[str]:
    _, tgt = sample_schemas(spark)
    return [n for n, c in tgt.items() if not c.nullable]
