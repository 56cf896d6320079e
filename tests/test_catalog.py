"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatlens import catalog
from chatlens.sources import fixtures

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
# These run jobs when called and return a finished table.
EAGER = {"sink_table", "sink_csv", "stream_avg_words_updates", "pagerank", "pagerank_reversed", "pagerank_symmetric", "pagerank_cut"}
EAGER |= {"stream_updates_compacted", "late_records_streamed", "apply_offset_updates_streamed", "merge_old_new_streamed"}
EAGER |= {"purge_expired_sessions_by_day", "purge_all_sessions_by_day"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert differences(ours, duck.execute(ORACLE[name]).df()) is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_has_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|MapInPandas|BatchEvalPython", plan)


def test_only_needed_columns_and_rows_are_read(spark):
    plan = plan_of(QUERIES["avg_delay_by_user"](spark, SF))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>", plan)
    sessions = fixtures.delay_messages(spark, SF).filter(F.col("user_id") == "3").select("login")
    assert "ReadSchema: struct<user_id:bigint>" in plan_of(sessions)


def test_windows_need_one_shuffle(spark):
    for name in ("avg_delay_by_user", "avg_words_1m_per_user", "msg_count_by_chat"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("Exchange hashpartitioning") == 1 and "partial_" in plan


def test_panes_are_added_up_before_they_are_doubled(spark):
    lines = plan_of(QUERIES["avg_delay_by_user_panes"](spark, SF)).splitlines()
    doubled = max(at for at, line in enumerate(lines) if re.search("Generate explode|Expand", line))
    # The plan is read from below: two aggregates of panes, then the doubling.
    assert sum("HashAggregate" in line for line in lines[doubled:]) >= 2
    assert not any("Expand" in line for line in lines)


def test_invitations_are_read_once(spark):
    plan = plan_of(QUERIES["new_chats_from_invitations"](spark, SF))
    assert plan.count("FileScan") == 2


@pytest.mark.parametrize("name", ["apply_offset_updates", "new_chats_from_invitations"])
def test_no_sort_before_aggregates(spark, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, SF))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["window_start", "window_end", "user_id", "avg_diff_time_ms"] and df.count() > 0
