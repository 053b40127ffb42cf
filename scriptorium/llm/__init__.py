"""Operators for preparing training corpora. Nothing else in the package imports this one."""

from __future__ import annotations


def queries() -> dict:
    from .query_set import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLES

    return dict(ORACLES)
