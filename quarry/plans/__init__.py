"""Registered queries: one module for each section of the operator inventory."""

from __future__ import annotations

from . import access, extensions, filters, formulas, logs, pages, relations, scans, sql, state, tooling, writes  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
