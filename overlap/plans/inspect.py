"""Plan inspection helpers (used by tests and for tuning): physical plan text, node counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    """The physical plan as text (Exchanges included).

    Before execution this is AQE's initial plan; after an action on ``df`` it is the final
    re-optimised plan.
    """
    text = df._jdf.queryExecution().executedPlan().toString()
    # an executed adaptive plan prints the final plan, then the initial one: keep the final
    return text.split("== Initial Plan ==")[0]


def count_nodes(plan: str, name: str) -> int:
    return plan.count(name)


def exchanges(plan: str, first_key: str) -> int:
    """Number of hash Exchanges whose first partitioning key is ``first_key``."""
    return len(re.findall(r"Exchange hashpartitioning\(" + re.escape(first_key) + r"#", plan))
