"""Plan regression tests: the scale properties the README claims, read from
Spark's physical plans, plus a scan of the library for calls it must not use."""

import pathlib
import re

import __spark_entry__ as E
from plan_text import final_plan

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


def _plan(spark, name):
    return final_plan(E.queries()[name](spark, SF))


def test_lines_are_aggregated_before_the_shuffle(spark):
    plan = _plan(spark, "top_products")
    # partial sums run map-side, before the exchange on the product key
    assert re.search(r"HashAggregate\(keys=\[id_producto#\d+L\], functions=\[partial_sum", plan)


def test_date_range_reaches_the_scan(spark):
    plan = _plan(spark, "sales_report")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate", plan)


def test_category_dimension_is_broadcast_not_shuffled(spark):
    plan = _plan(spark, "catalog_search_default")
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan  # the only exchange on p_type is that of the distinct types themselves


def test_running_sums_are_windowed_by_key_and_part(spark):
    plan = _plan(spark, "stock_ledger")
    assert re.search(r"Window \[.*\], \[id_producto#\d+L, _part#\d+\]", plan)
    assert not re.search(r"Window \[[^\n]*\], \[id_producto#\d+L\], \[fecha", plan)


def test_one_row_values_are_subqueries_not_joins(spark):
    plan = _plan(spark, "dashboard_kpis")
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan  # the KPIs are subqueries; joins inside them are by key


def test_library_avoids_forbidden_calls():
    bad = re.compile(r"localCheckpoint|crossJoin|\.collect\(\)|toPandas\(\)|@udf|F\.udf\(|\.rdd\b")
    hits = []
    for p in (ROOT / "vitrina").rglob("*.py"):
        if p.parent.name == "llm":  # collects tables of bounded size; has tests of its own
            continue
        for i, line in enumerate(p.read_text().splitlines(), 1):
            if bad.search(line):
                hits.append(f"{p.relative_to(ROOT)}:{i}: {line.strip()}")
    assert hits == []


def test_replays_read_ordered_partitions(spark):
    """The replays see the checkpointed range partitions as they are: only the
    small table of entries is joined, by broadcast, with no shuffle of the rows."""
    for name in ("oversell_guard", "active_carts"):
        plan = _plan(spark, name)
        at = plan.index("MapInPandas")
        below = plan[at:].splitlines()[:6]
        assert any("BroadcastHashJoin" in x for x in below) and not any("Exchange" in x and "Broadcast" not in x for x in below[:3]), below
