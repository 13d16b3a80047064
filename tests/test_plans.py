"""Filters and column pruning reach the scans."""

import re

from conftest import SF

from turnmill.plans import registry

registry.load_all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(registry.QUERIES["category_date_filter"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert "o_totalprice" not in plan and "l_extendedprice" not in plan
    plan = plan_of(registry.QUERIES["circular_hits"](spark, SF))
    assert "l_extendedprice" not in plan


def test_bucket_totals_read_narrow_columns(spark):
    """The totals side of a running sum over encoded samples does not read the token arrays."""
    from turnmill.operators.pack import range_fragments
    from turnmill.plans.packing import sourced_samples
    plan = plan_of(range_fragments(sourced_samples(spark, SF), 256))
    reads = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert any("input_ids" not in r for r in reads) and any("input_ids" in r for r in reads)
