"""All queries of the core and the SQL that each must agree with."""

from __future__ import annotations

from . import data_quality, knowledge, records, relations, retrieval, scans, structure, work

MODULES = (data_quality, retrieval, structure, scans, knowledge, work, records, relations)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
