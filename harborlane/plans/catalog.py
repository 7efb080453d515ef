"""All registered queries."""

from __future__ import annotations

from harborlane.plans import operations, scheduling, streams, trail, transfer  # noqa: F401
from harborlane.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
