"""Query registration: a name, a Spark plan and, where possible, checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.plans.views import with_views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``check`` may refer to views as ``{name}``."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if check is not None:
            CHECKS[name] = with_views(check)
        return plan

    return register
