"""Plans of the registered queries: no nested loops, filters and columns reach the scan."""

import os
import re

import pytest

from framelake.plans import boxes, detail, evidence, ledger, registry, sampling, tracks, vision  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(registry.QUERIES[name](spark, DATA)))


def test_scans_read_what_they_need(spark):
    text = plan(registry.QUERIES["as_of_backward"](spark, DATA))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in text
    assert "props" not in text
