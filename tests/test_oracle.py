"""Every registered query against its oracle text."""
import pytest

import __spark_entry__ as contract
from check_oracle import canonical, oracle
from conftest import SMALL
from tidemark.plans import registry


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    got = contract.queries()[name](spark, SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if p in plan]
    want = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["coerce_types", "day_summary", "log_display", "log_timeline", "marker_window", "ordered_scan_whole",
                                  "perf_windows", "progress_speed", "source_max_batch", "batch_ranges"])
def test_results_do_not_depend_on_the_session_zone(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_matches_oracle(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["many_windows", "resume_rows", "gap_replay"])
def test_windows_do_not_depend_on_the_session_zone(spark, duck, name):
    test_results_do_not_depend_on_the_session_zone(spark, duck, name)
