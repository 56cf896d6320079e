"""Read positions against plain loops, with one chat holding a third of the log."""

import datetime as dt
import random

import pytest

from chatlens.operators import cursors as cur

START = dt.datetime(2024, 1, 1)
OFFSETS = ["users_offset_0", "users_offset_1", "users_offset_2"]


def ms_of(at):
    return int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    log, members = [], []
    for chat in ["chat--hot", *[f"chat--{i}" for i in range(12)]]:
        size = 150 if chat == "chat--hot" else rng.randrange(0, 30)
        for part in range(3):
            for offset in range(size // 3):
                if rng.random() < 0.9:  # a log may have gaps
                    log.append((chat, part, offset, START + dt.timedelta(seconds=rng.randrange(10**6)), f"{chat}{part}{offset}"))
        for user in range(25 if chat == "chat--hot" else rng.randrange(1, 6)):
            ends = [rng.choice([0, size // 3, rng.randrange(size // 3 + 2)]) for _ in range(3)]
            members.append((f"u{user}", chat, f"name {chat}", ms_of(START) + rng.randrange(10**9), False, *ends))
    schema = "user_id string, chat_id string, chat_name string, message_time long, silent boolean, " + ", ".join(
        f"{name} long" for name in OFFSETS
    )
    frames = (
        spark.createDataFrame(log, "chat_id string, partition int, offset long, server_time timestamp, content string").cache(),
        spark.createDataFrame(members, schema).cache(),
    )
    return log, members, *frames


def wanted_unread(log, members):
    return {
        (user, chat, part, offset)
        for user, chat, _, _, _, *ends in members
        for c, part, offset, _, _ in log
        if c == chat and offset >= ends[part]
    }


def test_unread_records(world):
    log, members, log_df, members_df = world
    positions = cur.cursors(members_df, OFFSETS)
    got = cur.unread_messages(log_df, positions).select("user_id", "chat_id", "partition", "offset").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == wanted_unread(log, members)


def test_unread_records_across_blocks(world, monkeypatch):
    log, members, log_df, members_df = world
    monkeypatch.setattr(cur, "OFFSETS_PER_BLOCK", 7)
    positions = cur.cursors(members_df, OFFSETS)
    got = cur.unread_messages(log_df, positions).select("user_id", "chat_id", "partition", "offset").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == wanted_unread(log, members)


@pytest.mark.parametrize("per_block", [7, None])
def test_unread_ranges(world, per_block):
    log, members, log_df, members_df = world
    want = {}
    for user, chat, _, _, _, *ends in members:
        for part in range(3):
            left = [(offset, ms_of(at)) for c, p, offset, at, _ in log if (c, p) == (chat, part) and offset >= ends[part]]
            want[user, chat, part] = (len(left), max((o for o, _ in left), default=None), max((t for _, t in left), default=None))
    got = cur.unread_ranges(log_df, cur.cursors(members_df, OFFSETS), per_block).collect()
    assert {(r.user_id, r.chat_id, r.partition): (r.unread, r.last_offset, r.newest_ms) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize("per_block", [1, 2, 100, 65_536])
def test_unread_ranges_over_gaps_and_repeated_records(spark, per_block):
    """Blocks without records, partitions that end early, records and positions that repeat, nulls, offsets below zero."""
    rng = random.Random(per_block)
    places = [-3, 0, 1, 2, 250, 255, 256, 257, 511, 512, 70_000, 70_001, 200_000, 10**12]
    log = [("a", p, o, START + dt.timedelta(seconds=rng.randrange(999)) if rng.random() < 0.9 else None, "x")
           for p, some in ((0, places), (1, places[:4]), (2, places[9:])) for o in some for _ in range(rng.choice([1, 1, 3]))]
    log += [("b", 0, 5, START, "x"), (None, 0, 0, START, "x"), ("a", None, 0, START, "x"), ("a", 0, None, START, "x")]
    asked = [(f"u{n}", chat, p, o + d) for chat in ("a", "b", "c") for p in range(3) for n, o in enumerate(places) for d in (0, 1)]
    asked += [asked[0], (None, "a", 0, 2)]
    lost = [("u", None, 0, 1), ("u", "a", None, 1), ("u", "a", 0, None)]  # positions that are nowhere
    log_df = spark.createDataFrame(log, "chat_id string, partition int, offset long, server_time timestamp, content string")
    got = cur.unread_ranges(log_df, spark.createDataFrame(asked + lost, "user_id string, chat_id string, partition int, offset long"), per_block)
    want = []
    for user, chat, part, offset in asked:
        left = [(o, at) for c, p, o, at, _ in log if (c, p) == (chat, part) and o is not None and o >= offset]
        want.append((user, chat, part, offset, len(left), max((o for o, _ in left), default=None), max((ms_of(t) for _, t in left if t), default=None)))
    assert sorted(map(str, want)) == sorted(
        str((r.user_id, r.chat_id, r.partition, r.offset, r.unread, r.last_offset, r.newest_ms)) for r in got.collect())


@pytest.mark.parametrize("per_block", [2, 7, None])
def test_memberships_come_out_as_cursors(world, per_block):
    _, _, log_df, members_df = world
    want = cur.unread_ranges(log_df, cur.cursors(members_df, OFFSETS, "message_time"), per_block)
    got = cur.unread_ranges(log_df, members_df.select("user_id", "chat_id", "message_time", *OFFSETS), per_block, OFFSETS)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_positions_and_records_move_once(world):
    """Positions meet one directory: they are not dealt by place first, and answers do not travel back to them."""
    _, _, log_df, members_df = world
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(cur.unread_ranges(log_df, cur.cursors(members_df, OFFSETS))) == 2
    assert exchanges(cur.unread_count(log_df, cur.cursors(members_df, OFFSETS))) == 3
    assert exchanges(cur.mark_read(log_df, members_df, OFFSETS)) == 3


def test_an_empty_log_leaves_nothing_unread(world):
    _, _, log_df, members_df = world
    got = cur.unread_ranges(log_df.limit(0), cur.cursors(members_df, OFFSETS))
    assert {(r.unread, r.last_offset, r.newest_ms) for r in got.collect()} == {(0, None, None)}
    assert cur.unread_count(log_df, cur.cursors(members_df.limit(0), OFFSETS)).collect() == []


def test_readers_are_found_before_the_log_is_dealt(world):
    """The pairs read a table of readers with something left; who is up to date has left the disk by then."""
    _, _, log_df, members_df = world
    plan = cur.unread_in_time_order(log_df, cur.cursors(members_df, OFFSETS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1


@pytest.mark.parametrize("pieces", [40, None])
def test_chat_list(world, pieces):
    log, members, log_df, members_df = world
    per_user = {}
    for user, chat, _, last, _, *ends in members:
        left = [ms_of(at) for c, part, offset, at, _ in log if c == chat and offset >= ends[part]]
        per_user.setdefault(user, []).append((-(max(left) if left else last), chat))
    want = {(user, chat): place for user, chats in per_user.items() for place, (_, chat) in enumerate(sorted(chats), 1)}
    got = cur.chat_list_order(log_df, members_df, OFFSETS, 7, pieces).collect()
    assert {(r.user_id, r.chat_id): r.position for r in got} == want


def test_history_pages(world):
    log, members, log_df, members_df = world
    positions = cur.cursors(members_df, OFFSETS)
    for page in (0, 1, 2):
        want = set()
        for user, chat, _, _, _, *ends in members:
            stops = [max(end - 15 * page, 0) for end in ends]
            if sum(stops) == 0:
                continue
            starts = [max(stop - 15, 0) for stop in stops]
            want |= {
                (user, chat, part, offset)
                for c, part, offset, _, _ in log
                if c == chat and starts[part] <= offset < stops[part]
            }
        got = cur.history_page(log_df, positions, page).select("user_id", "chat_id", "partition", "offset").collect()
        assert set(map(tuple, got)) == want and len(got) == len(want)


def test_next_offsets_never_go_back(spark):
    log = spark.createDataFrame([("c", 0, 4, START), ("c", 1, 2, START)], "chat_id string, partition int, offset long, server_time timestamp")
    positions = spark.createDataFrame([("u", "c", 0, 1), ("u", "c", 1, 9), ("u", "c", 2, 7)], "user_id string, chat_id string, partition int, offset long")
    assert {(r.partition, r.offset) for r in cur.next_offsets(log, positions).collect()} == {(0, 5), (1, 9), (2, 7)}


def test_updates_with_repeated_and_null_partitions(spark):
    members = spark.createDataFrame([("u", "c", 1, 0, 0)], "user_id string, chat_id string, message_time long, users_offset_0 long, users_offset_1 long")
    updates = spark.createDataFrame(
        [("u", "c", 9, [(0, 3), (0, 5), (None, 2)], 1)],
        "user_id string, chat_id string, last_message_time long, partition_offsets array<struct<partition int, offset long>>, arrival long",
    )
    assert tuple(cur.apply_offset_updates(members, updates, OFFSETS[:2]).first()) == ("u", "c", 9, 6, 0)


def test_offset_updates_equal_a_replay(spark):
    rng = random.Random(5)
    members = [(f"u{i}", "c", i, rng.randrange(5), rng.randrange(5)) for i in range(20)]
    updates, stored = [], {}
    for user, chat, time, *offsets in members:
        stored[user, chat] = (offsets, time)
    for arrival in range(200):
        # Positions come in any partition order, and some are for chats nobody has.
        offsets = [(part, rng.randrange(8)) for part in rng.sample([0, 1], 2)]
        updates.append((f"u{rng.randrange(22)}", rng.choice(["c", "c", "x"]), arrival * 10, offsets, arrival))
    current = dict(stored)
    seen = {key: sum(offsets) for key, (offsets, _) in stored.items()}
    for user, chat, time, offsets, _ in updates:
        total = sum(offset for _, offset in offsets)
        if (user, chat) in current and total > seen[user, chat]:
            seen[user, chat] = total
            current[user, chat] = ([offset + 1 for _, offset in sorted(offsets)], time)
    schema = "user_id string, chat_id string, message_time long, users_offset_0 long, users_offset_1 long"
    got = cur.apply_offset_updates(
        spark.createDataFrame(members, schema),
        spark.createDataFrame(
            updates,
            "user_id string, chat_id string, last_message_time long, "
            "partition_offsets array<struct<partition int, offset long>>, arrival long",
        ),
        OFFSETS[:2],
    )
    assert got.columns == ["user_id", "chat_id", "message_time", "users_offset_0", "users_offset_1"]
    assert {(r.user_id, r.chat_id): ([r.users_offset_0, r.users_offset_1], r.message_time) for r in got.collect()} == current


def test_mark_read_folds_unread_into_read(world):
    log, members, log_df, members_df = world
    want = {}
    for user, chat, _, last, _, *ends in members:
        left = [(part, offset, ms_of(at)) for c, part, offset, at, _ in log if c == chat and offset >= ends[part]]
        time = max([last, *[t for _, _, t in left]])
        offsets = [max([ends[part], *[o for p, o, _ in left if p == part]]) for part in range(3)]
        want[user, chat] = (time, *offsets)
    got = cur.mark_read(log_df, members_df, OFFSETS).collect()
    assert {(r.user_id, r.chat_id): tuple(r)[2:] for r in got} == want


def test_merging_pages_keeps_each_record_once(world):
    log, _, log_df, _ = world
    merged = cur.merge_old_new(log_df.filter("offset >= 5"), log_df.filter("offset < 8"))
    assert merged.count() == len(log)


def test_orders(world):
    _, _, log_df, members_df = world
    lines = [tuple(r) for r in cur.timeline(log_df).select("chat_id", "server_time", "partition", "offset").collect()]
    assert lines == sorted(lines)
    times = [(r.user_id, -r.message_time, r.chat_id) for r in cur.chats_by_last_message(members_df, newest_first=True).collect()]
    assert times == sorted(times)


def test_invitations(spark):
    invited = spark.createDataFrame(
        [("u", 3, "c1", "late name", "b"), ("u", 2, "c1", "first name", "a"), ("u", 5, "c2", "known", "a"), ("v", 1, "c1", "n", "a")],
        "user_id string, offset long, chat_id string, chat_name string, login string",
    )
    settings = spark.createDataFrame([("u", 3), ("v", 2), ("w", 8)], "user_id string, joining_offset long")
    backlog = cur.invitation_backlog(invited, settings)
    assert {(r.user_id, r.offset, r.my_joining_offset) for r in backlog.collect()} == {("u", 3, 4), ("u", 5, 6)}
    assert {tuple(r) for r in cur.next_joining_offsets(invited, settings).collect()} == {("u", 6), ("v", 2), ("w", 8)}
    known = spark.createDataFrame([("u", "c2")], "user_id string, chat_id string")
    fresh = cur.new_chats_from_invitations(invited, known, OFFSETS[:1])
    assert {tuple(r) for r in fresh.collect()} == {("u", "c1", "first name", "a", 0), ("v", "c1", "n", "a", 0)}


def test_typing(spark):
    rows = [(0, "c", "1"), (200, "c", "1"), (300, "c", "2"), (1_000, "c", "1")]
    writing = spark.createDataFrame(
        [(START + dt.timedelta(milliseconds=ms), chat, who, f"login {who}") for ms, chat, who in rows],
        "server_time timestamp, chat_id string, writer_id string, writer_login string",
    )
    assert cur.typing_now(writing).count() == 3
    assert {r.writer_id for r in cur.typing_now(writing, me="1").collect()} == {"2"}
