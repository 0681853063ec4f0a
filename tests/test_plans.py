"""Plan properties: no all-pairs joins, filters and columns reach the scan, group limits are used."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
# These run their stages while the plan is built, or run a stream.
STAGED = ("i18", "t3_", "t9_", "t12", "t16", "snk4", "m17", "str", "op", "pipeline")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(STAGED)))
def test_no_all_pairs_join(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scope_filter_reaches_the_scan(spark, capsys):
    QUERIES["p1_scope_filter"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderdate" not in plan


def test_top_frames_use_a_group_limit(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["l5_top_frames"](spark, FOLDER))


def test_keyset_page_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["l3_keyset_page"](spark, FOLDER))


def test_span_scans_never_partition_by_run_alone(spark):
    """Row-level windows of the span algebra are partitioned by run and slice."""
    for name in ("w2_running_open_end", "i4_gap_merge", "i6_silence", "j13_nearest_endpoint"):
        frame = QUERIES[name](spark, FOLDER)
        text = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert any("__bucket" in w or "__slice" in w for w in windows)
