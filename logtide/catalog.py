"""Registered queries and their SQL."""

from __future__ import annotations

from .plans import modelling
from .plans.queries import QUERIES
from .plans.sql import ORACLE, compose


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE) | {name: compose(parts, final) for name, (parts, final) in modelling.SQL.items()}
