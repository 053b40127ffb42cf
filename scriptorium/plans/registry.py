"""The registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
