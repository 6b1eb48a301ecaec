"""Imports every query module so the registry is complete."""
from __future__ import annotations

from maplift.plans import q_history, q_load, q_mapping, q_stream, q_text, q_validate  # noqa: F401
from maplift.plans.oracle import ORACLE
from maplift.plans.oracle_history import ORACLE_HISTORY, ORACLE_STREAM
from maplift.plans.oracle_load import ORACLE_LOAD
from maplift.plans.oracle_text import ORACLE_TEXT
from maplift.plans.oracle_validate import ORACLE_VALIDATE
from maplift.plans.registry import QUERIES

_ORACLES = [ORACLE, ORACLE_VALIDATE, ORACLE_LOAD, ORACLE_HISTORY, ORACLE_TEXT, ORACLE_STREAM]


def all_queries():
    return dict(QUERIES)


def all_oracles():
    merged: dict[str, str] = {}
    for o in _ORACLES:
        merged.update(o)
    return {k: v for k, v in merged.items() if k in QUERIES}
