"""What no registered query may do, whatever the size of its tables."""

import re

import pytest

from __spark_entry__ import queries
from conftest import SMALLEST, plan

QUERIES = queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.fixture(scope="module")
def static(spark):
    """Plans as they are before any run, with no table counted as small."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, static, name):
    text = plan(QUERIES[name](spark, SMALLEST))
    for operator in FORBIDDEN:
        assert operator not in text
    # a window without a partition would hold the whole table in one task
    for first in re.findall(r"windowspecdefinition\(([^,]+),", text):
        assert not re.search(r" (ASC|DESC) |specifiedwindowframe", first)


def test_the_window_rule_sees_a_window_without_partition(spark, static):
    text = plan(spark.range(3).selectExpr("row_number() OVER (ORDER BY id)", "sum(id) OVER ()"))
    firsts = re.findall(r"windowspecdefinition\(([^,]+),", text)
    assert len(firsts) == 2 and all(re.search(r" (ASC|DESC) |specifiedwindowframe", f) for f in firsts)


@pytest.mark.parametrize("name", ["filter_basic", "filter_range", "flow_end_to_end", "partition_pruned_scan"])
def test_filters_reach_the_scan(spark, static, name):
    assert "PushedFilters: [IsNotNull" in plan(QUERIES[name](spark, SMALLEST)) or "PushedFilters: [Or" in plan(
        QUERIES[name](spark, SMALLEST))
