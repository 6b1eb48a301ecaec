"""Table access: `${ref()}` resolution (A3) over a folder of Parquet tables."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from maplift.model import DEFAULT_SOURCE_SCHEMA

REF_PATTERN = r"""\$\{\s*ref\(\s*['"]([\w.]+)['"]\s*\)\s*\}"""


def qualify(name: str, default_schema: str = DEFAULT_SOURCE_SCHEMA) -> str:
    """A dotted name is used as is, otherwise prefixed with the default schema."""
    return name if "." in name else f"{default_schema}.{name}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder.

    The folder is the default schema (`raw.<name>` or `<name>`); another schema is a
    sub-folder of that name."""
    schema, _, bare = name.rpartition(".")
    folder = sf_dir.rstrip("/") if schema in ("", DEFAULT_SOURCE_SCHEMA) else f"{sf_dir.rstrip('/')}/{schema.replace('.', '/')}"
    return spark.read.parquet(f"{folder}/{bare}.parquet")


def ref(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Resolve `${ref("t")}` (or a bare name) and read that table."""
    m = re.fullmatch(REF_PATTERN, text.strip())
    name = m.group(1) if m else text.strip()
    return read_table(spark, sf_dir, qualify(name))
