"""Cursors on a laid-out log: equal to the log itself, and without a shuffle of its records."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlens.operators import cursors
from chatlens.plans import scratch_path
from chatlens.sources import layout

LOG = "chat_id string, partition int, offset long, server_time timestamp, content string"
POSITIONS = "user_id string, chat_id string, partition int, offset long"
START = dt.datetime(2024, 1, 1)


def records(draw, chats=4, busy=400):
    rows = []
    for chat in range(chats):
        for partition in range(2):
            offset = 0
            # One chat holds most records; offsets have gaps, times are in no order.
            for _ in range(busy if chat == 0 else draw.randint(0, 12)):
                offset += draw.choice([1, 1, 1, 2, 9, 700])
                rows.append((f"c{chat}", partition, offset, START + dt.timedelta(seconds=draw.randint(0, 10_000)), "x"))
    return rows


def positions(draw, rows, users=60):
    ends = {}
    for chat, partition, offset, *_ in rows:
        ends[chat, partition] = max(offset, ends.get((chat, partition), 0))
    found = []
    for user in range(users):
        for chat, partition in [*ends, ("unknown", 0)]:
            end = ends.get((chat, partition), 5)
            found.append((f"u{user}", chat, partition, draw.choice([0, end, end + 1, end + 500, draw.randint(0, end)])))
    return found


def listed(df):
    return sorted(map(str, (tuple(row) for row in df.collect())))


@pytest.fixture(scope="module", params=[1, 4, 256])
def both(spark, request):
    draw = random.Random(request.param)
    rows = records(draw)
    log = spark.createDataFrame(rows, LOG)
    where = spark.createDataFrame(positions(draw, rows), POSITIONS)
    return log, layout.lay_out(log, buckets=6, per_cell=request.param), where


@pytest.mark.parametrize("operator", ["unread_ranges", "unread_count", "unread_messages", "records_since", "history_page", "next_offsets"])
def test_results_equal_those_of_the_log(both, operator):
    log, laid, where = both
    run = getattr(cursors, operator)
    want = run(log, where)
    got = run(laid, where)
    if operator == "unread_ranges":
        # Positions after all records and in unknown chats have nothing unread either way.
        assert got.filter("unread > 0").count() > 0
    assert listed(got.select(*want.columns)) == listed(want)


def log_is_shuffled(df):
    """Whether an exchange lies above the scan of the records, by the indentation of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+|-]*", line).group()) for line in lines]
    scans = [at for at, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert scans
    for at in scans:
        level = depth[at]
        for above in range(at - 1, -1, -1):
            if depth[above] < level:
                level = depth[above]
                if "SortMergeJoin" in lines[above]:
                    break
                if "Exchange" in lines[above]:
                    return True
    return False


@pytest.mark.parametrize("operator", ["unread_ranges", "unread_messages", "records_since", "history_page"])
def test_records_meet_cursors_where_they_are(both, operator):
    _, laid, where = both
    assert not log_is_shuffled(getattr(cursors, operator)(laid, where))


def test_records_are_met_by_positions_inside_a_cell_only(spark):
    """Positions at the begin of a cell, past its end or in a cell without records need the summary alone."""
    rows = [("c", 0, offset, START + dt.timedelta(seconds=offset), "x") for offset in (0, 1, 2, 3, 8, 9, 40)]
    laid = layout.lay_out(spark.createDataFrame(rows, LOG), buckets=2, per_cell=4)
    laid.in_cells = laid.in_cells.filter("offset < 8 or offset > 9")  # the summary still has these two
    where = spark.createDataFrame([("u", "c", 0, offset) for offset in (0, 1, 4, 6, 8, 10, 12, 40, 41)], POSITIONS)
    got = {row["offset"]: (row["unread"], row["last_offset"]) for row in cursors.unread_ranges(laid, where).collect()}
    assert got == {0: (7, 40), 1: (6, 40), 4: (3, 40), 6: (3, 40), 8: (3, 40), 10: (1, 40), 12: (1, 40), 40: (1, 40), 41: (0, None)}


def test_wide_positions_give_the_same(both):
    log, laid, where = both
    wide = where.groupBy("user_id", "chat_id").pivot("partition", [0, 1]).agg(F.max("offset")).withColumnsRenamed({"0": "a", "1": "b"})
    want = cursors.unread_ranges(log, cursors.cursors(wide, ["a", "b"]))
    got = cursors.unread_ranges(laid, wide, offset_columns=["a", "b"])
    assert listed(got.select(*want.columns)) == listed(want)


def test_records_since_the_smallest_position(both):
    log, _, where = both
    low = {}
    for row in where.collect():
        place = row["chat_id"], row["partition"]
        low[place] = min(row["offset"], low.get(place, row["offset"]))
    want = [str(tuple(row)) for row in log.collect() if row["offset"] >= low[row["chat_id"], row["partition"]]]
    # Somebody stands at 0 in every partition, so leave those out for a narrower start.
    assert listed(cursors.records_since(log, where)) == sorted(want)
    ahead = where.filter("offset > 20")
    assert 0 < cursors.records_since(log, ahead).count() < log.count()


def test_next_offsets_read_no_records(both):
    _, laid, where = both
    plan = cursors.next_offsets(laid, where)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" not in plan and "last_offset:bigint" in plan


def test_a_layout_grows_and_opens_again(spark):
    rows = records(random.Random(5))
    rows.sort(key=lambda row: row[2])
    path = scratch_path(spark, "grown")
    where = spark.createDataFrame(positions(random.Random(6), rows), POSITIONS)
    layout.lay_out(spark.createDataFrame(rows[:300], LOG), path, buckets=4, per_cell=8)
    schema = layout.add_records(spark.createDataFrame(rows[300:], LOG), path, 4, 8)
    again = layout.open_layout(spark, path, schema, 4, 8)
    log = spark.createDataFrame(rows, LOG)
    assert listed(again.records) == listed(log)
    assert listed(cursors.unread_ranges(again, where)) == listed(cursors.unread_ranges(log, where))
    assert not log_is_shuffled(cursors.unread_ranges(again, where))


def test_a_busy_chat_lies_in_all_buckets(both):
    _, laid, _ = both
    if laid.per_cell == 1:
        files = laid.in_cells.filter("chat_id = 'c0'").select(F.input_file_name().alias("f")).distinct().count()
        assert files == laid.buckets


def test_empty_log_and_no_positions(spark):
    empty = layout.lay_out(spark.createDataFrame([], LOG), buckets=2)
    where = spark.createDataFrame([("u", "c", 0, 3)], POSITIONS)
    (row,) = cursors.unread_ranges(empty, where).collect()
    assert (row["unread"], row["last_offset"], row["newest_ms"]) == (0, None, None)
    assert cursors.unread_count(empty, where.limit(0)).collect() == []
