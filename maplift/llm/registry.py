"""Queries of the subpackage: key -> callable(spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(key: str):
    def deco(fn):
        LLM_QUERIES[key] = fn
        return fn
    return deco
