"""Rows made by explode are never broadcast: Spark sizes them by what they were made from."""

from __future__ import annotations

import pytest
from terraloom.plans.queries import QUERIES


def exploded_broadcasts(df) -> list[str]:
    """Lines of the plan that make rows below a broadcast."""
    found, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if under is not None and depth <= under:
            under = None
        if under is None and line.lstrip(" :+-").startswith("BroadcastExchange"):
            under = depth
        elif under is not None and "Generate explode" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["validation_by_node", "validation_report", "cross_patch_flags", "lattice_openings", "ray_verdicts"])
def test_nothing_exploded_is_broadcast(spark, sf_dir, name):
    assert exploded_broadcasts(QUERIES[name](spark, sf_dir)) == []


def test_nothing_exploded_is_broadcast_once_planned_again(spark, sf_dir):
    df = QUERIES["ray_verdicts"](spark, sf_dir)
    df.collect()  # from here on the plan is the one that ran, and the one it began as
    assert "Final Plan" in df._jdf.queryExecution().executedPlan().toString()
    assert exploded_broadcasts(df) == []
