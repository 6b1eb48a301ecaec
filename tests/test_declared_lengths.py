"""Declared text lengths (A9): longer values abort a load, blanks beyond the limit are cut off."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maplift.functions.rules import length_limit
from maplift.operators.load import conform, current_files, read_current
from maplift.plans.mapping import sample_schema_columns
from maplift.plans.workflow import run_mapping, run_mappings
from maplift.session import fresh_path
from maplift.sources.samples import sample_sheet
from tests.test_sample_mapping import LOAD_TS, seed_df
from tests.test_shared_source import sheets_of


@pytest.mark.parametrize("name, n", [("VARCHAR(20)", 20), (" varchar ( 3 ) ", 3), ("CHAR(1)", 1), ("character varying(7)", 7), ("VARCHAR", None),
                                     ("NUMERIC(10,2)", None), ("TEXT", None)])
def test_limits_of_type_names(name, n):
    assert length_limit(name) == n


def test_texts_are_held_to_their_length(spark):
    df = spark.createDataFrame([("abc", 1), ("ab", 2), ("abc   ", 3), (None, 4), ("", 5), ("äöü", 6)], "a string, b int")
    got = [(r.a, r.b) for r in conform(df, {"a": "VARCHAR(3)", "b": "bigint"}).collect()]
    assert got == [("abc", 1), ("ab", 2), ("abc", 3), (None, 4), ("", 5), ("äöü", 6)]
    with pytest.raises(PySparkException, match='too long for column "a" of type VARCHAR'):
        conform(df.unionByName(df.withColumn("a", F.lit("abcd"))), {"a": "VARCHAR(3)", "b": "bigint"}).collect()
    assert [r.b for r in conform(df, {"b": "VARCHAR(1)"}).collect()] == ["1", "2", "3", "4", "5", "6"]


def limited(spark, ids, n):
    cols = sample_schema_columns(spark, ids)
    city = (F.col("column_name") == "site_city") & (F.col("sheet_id") == ids[-1])
    return cols.withColumn("type", F.when(city, F.lit(f"VARCHAR({n})")).otherwise(F.col("type")))


def test_a_load_with_a_long_value_is_not_committed(spark):
    root = fresh_path(spark, "limited")
    assert run_mapping(sample_sheet(spark), limited(spark, [0], 7), seed_df(spark), root, LOAD_TS).status == "succeeded"
    assert dict(read_current(spark, root).dtypes)["site_city"] == "string"
    other = fresh_path(spark, "limited")
    with pytest.raises(PySparkException, match="VARCHAR"):  # Chennai has seven letters
        run_mapping(sample_sheet(spark), limited(spark, [0], 6), seed_df(spark), other, LOAD_TS)
    assert current_files(spark, other) is None
    roots = {0: fresh_path(spark, "l0"), 1: fresh_path(spark, "l1")}
    got = run_mappings(sheets_of(spark, {}, {}), limited(spark, [0, 1], 6), seed_df(spark), roots, LOAD_TS)
    assert (got[0].status, got[1].failed_step) == ("succeeded", "execute")
