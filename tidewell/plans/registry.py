"""The rhythm queries by name, and their SQL."""

from __future__ import annotations

from tidewell.plans import oracle
from tidewell.plans import queries as q

entry = q.entry


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(oracle.ORACLE)
