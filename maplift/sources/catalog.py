"""A4: live catalog columns of tables, from their Spark schemas.

Only metadata is touched (`df.schema`); no data is read.  The result has
the `schema_columns` shape, so drift checks (D6) and validation can join
declared documents against it.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPE_NAMES = {
    T.StringType: "VARCHAR", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.ShortType: "SMALLINT",
    T.DoubleType: "DOUBLE PRECISION", T.FloatType: "REAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP", T.DecimalType: "NUMERIC",
}


class CatalogError(LookupError):
    pass


def type_name(dt: T.DataType) -> str:
    for k, v in _TYPE_NAMES.items():
        if isinstance(dt, k):
            return v
    return dt.simpleString().upper()


def catalog_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, type, nullable) for each table, in
    column order.  A table without columns is an error."""
    rows = []
    for name, df in tables.items():
        fields = df.schema.fields
        if not fields:
            raise CatalogError(f"Table {name} not found")
        rows += [(name, i + 1, f.name, type_name(f.dataType), bool(f.nullable)) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, "
                                       "nullable boolean")
