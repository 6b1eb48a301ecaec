"""From `documents` to packed training sequences, in five stages.

1. toxicity: documents that the classifier rejects go;
2. line_dedup: later matches of lines go, and documents of which nothing is left;
3. near_duplicates: one document of each group stays (five words, similarity 0.8);
4. decontamination: documents that hold a passage of `benchmark` go;
5. packing: what is left, in as few sequences as possible.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.llm.common import staged, table
from maplift.llm.decontaminate import without_contaminated
from maplift.llm.line_dedup import without_similar_lines
from maplift.llm.ngram_join import without_near_duplicates
from maplift.llm.packing import packed
from maplift.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = without_similar_lines(docs, num=80, den=100)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~F.coalesce(emptied, F.lit(False))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

#: Classifier scores and the packing cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
