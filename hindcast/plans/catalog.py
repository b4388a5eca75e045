"""All registered queries."""

from __future__ import annotations

from hindcast.plans import files, integrity, outcomes, scores, series, streams, texts  # noqa: F401
from hindcast.plans.registry import CHECKS, PLANS, Plan


def queries() -> dict[str, Plan]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
