"""Type families (B18) and lossy casts (B19) as Column expressions.

The family table is a fixed, 18-entry literal map, so it is applied with
``element_at(map, key)`` inside the projection -- no join, no shuffle.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from maplift.model import LOSSY_PAIRS, TYPE_FAMILY


def _family_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(TYPE_FAMILY.items())])


def type_base(type_col: Column) -> Column:
    """upper(type), cut at '(' and trimmed: NUMERIC(10,2) -> NUMERIC."""
    return F.trim(F.split(F.upper(type_col), r"\(", 2).getItem(0))


def type_family_of(name: str) -> str:
    """The family of one declared type name (for the driver, which compiles a sheet)."""
    return TYPE_FAMILY.get(name.upper().split("(", 1)[0].strip(" "), "other")


def type_family(type_col: Column) -> Column:
    return F.coalesce(F.try_element_at(_family_map(), type_base(type_col)), F.lit("other"))


def lossy_pair(src_family: Column, tgt_family: Column) -> Column:
    keys = [f"{a}>{b}" for a, b in LOSSY_PAIRS]
    return F.concat_ws(">", src_family, tgt_family).isin(keys)
