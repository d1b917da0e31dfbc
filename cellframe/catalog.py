"""The queries of the analyses, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
