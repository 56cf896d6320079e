import json

import pytest

from chatlens.operators import relational as rel

MEMBERSHIP = (
    "user_id string, chat_id string, chat_name string, message_time long, silent boolean, "
    "users_offset_0 long, users_offset_1 long, users_offset_2 long"
)


@pytest.fixture(scope="module")
def world(spark):
    users = spark.createDataFrame(
        [("a1", 1, "Ramon"), ("b2", 2, "Boris"), ("c3", 3, "Oliwia"), ("d4", 4, "ramon2")],
        "user_id string, user_num_id long, login string",
    )
    settings = spark.createDataFrame(
        [(u, i, 900_000, "Europe/Warsaw") for i, u in enumerate(["a1", "b2", "c3", "d4"])],
        "user_id string, joining_offset long, session_duration long, zone_id string",
    )
    chats = spark.createDataFrame([("chat--g", True), ("chat--a1--b2", False)], "chat_id string, group_chat boolean")
    rows = [(u, "chat--g", "Group", 100, False, 1, 2, 3) for u in ("a1", "b2", "c3")]
    rows += [(u, "chat--a1--b2", "Direct", 50, True, 0, 0, 7) for u in ("a1", "b2")]
    return users, settings, chats, spark.createDataFrame(rows, MEMBERSHIP)


def test_sessions(spark, world):
    sessions = spark.createDataFrame(
        [("s1", "a1", 10), ("s2", "a1", 20), ("s3", "b2", 10), ("s4", "zz", 1)],
        "session_id string, user_id string, validity_time long",
    )
    assert {r.session_id for r in rel.active_sessions(sessions, 10).collect()} == {"s2"}
    assert {r.session_id for r in rel.purge_expired_sessions(sessions, 10).collect()} == {"s1", "s2", "s3"}
    cutoffs = spark.createDataFrame([("a1", 15), ("b2", 10)], "user_id string, cutoff long")
    assert {r.session_id for r in rel.purge_expired_sessions(sessions, cutoffs).collect()} == {"s2", "s3", "s4"}
    assert {r.session_id for r in rel.user_sessions(sessions, world[0]).collect()} == {"s1", "s2", "s3"}
    assert {tuple(r) for r in rel.valid_session_count(sessions, 5).collect()} == {("a1", 2), ("b2", 1)}
    assert rel.session_expiries(world[0], world[1], 100).first().validity_time == 900_100


def test_search_ignores_case_and_takes_many_patterns(world):
    got = {tuple(r) for r in rel.search_users(world[0], ["RAMON", "^o", "nobody"]).collect()}
    assert got == {("RAMON", "a1", "Ramon"), ("RAMON", "d4", "ramon2"), ("^o", "c3", "Oliwia")}


def test_lookups(spark, world):
    wanted = spark.createDataFrame([("a1", "Ramon"), ("a1", "Boris"), ("x", "x")], "user_id string, login string")
    assert {r.user_id for r in rel.user_by_login(world[0], wanted).collect()} == {"a1", "b2"}
    assert {tuple(r) for r in rel.missing_users(world[0], wanted).collect()} == {("a1", "Boris"), ("x", "x")}


def test_profiles_keep_users_without_chats(world):
    users, settings, chats, members = world
    assert rel.user_profile_chats(users, settings, members, chats).count() == 5
    profile = rel.user_profile(users, settings, members, chats)
    assert profile.count() == 6
    assert {r.user_id for r in profile.filter("chat_id is null").collect()} == {"d4"}


@pytest.mark.parametrize("pieces", [9, None])
def test_profile_pages(world, pieces):
    users, settings, chats, members = world
    profile = rel.user_profile(users, settings, members, chats)
    pages = {(r.user_id, r.page): json.loads(r.json) for r in rel.encode_profile(profile, 1, pieces).collect()}
    assert set(pages) == {("a1", 0), ("a1", 1), ("b2", 0), ("b2", 1), ("c3", 0), ("d4", 0)}
    assert pages["d4", 0]["chatList"] == []
    assert pages["a1", 0] == {
        "user": {"userId": "a1", "login": "Ramon"},
        "settings": {"joiningOffset": 0, "sessionDuration": 900_000, "zoneId": "Europe/Warsaw"},
        "chatList": [
            {
                "chat": {
                    "chatId": "chat--a1--b2",
                    "chatName": "Direct",
                    "groupChat": False,
                    "lastMessageTime": 50,
                    "silent": True,
                },
                "partitionOffsets": [{"partition": p, "offset": o} for p, o in enumerate([0, 0, 7])],
            }
        ],
    }


def test_members_and_counts(world):
    users, _, chats, members = world
    assert rel.chat_members(members, users).count() == 5
    assert {tuple(r) for r in rel.chat_member_count(members).collect()} == {("chat--g", 3), ("chat--a1--b2", 2)}
    assert {tuple(r) for r in rel.chats_per_user(members).collect()} == {("a1", 2), ("b2", 2), ("c3", 1)}
    assert rel.my_chats(members, chats).count() == 5


@pytest.mark.parametrize("pieces", [20, None])
def test_a_large_chat_is_listed_in_pages(spark, pieces):
    users = spark.createDataFrame([(f"{i:03x}", i, f"n{i}") for i in range(300)], "user_id string, user_num_id long, login string")
    rows = [(f"{i:03x}", "hot") for i in range(300)] + [(f"{i:03x}", "small") for i in range(7)]
    members = spark.createDataFrame(rows, "user_id string, chat_id string")
    chats = spark.createDataFrame([("hot", True), ("small", True)], "chat_id string, group_chat boolean")
    pages = rel.chats_with_members(members, chats, users, 16, pieces).orderBy("chat_id", "page").collect()
    assert all(len(r.members) <= 16 for r in pages)
    listed = [m.user_id for r in pages if r.chat_id == "hot" for m in r.members]
    assert listed == [f"{i:03x}" for i in range(300)]
    assert [len(r.members) for r in pages if r.chat_id == "small"] == [7]


def test_direct_chats_under_either_order(spark):
    ids = ["chat--a--b", "chat--b--a", "chat--a--c"]
    chats = spark.createDataFrame([(i,) for i in ids], "chat_id string")
    assert [tuple(r) for r in rel.duplicate_direct_chats(chats).collect()] == [("a", "b", 2, "chat--a--b")]
    wanted = spark.createDataFrame([("chat--c--a",), ("chat--c--b",)], "chat_id string")
    assert [tuple(r) for r in rel.existing_direct_chats(wanted, chats).collect()] == [("chat--c--a",)]


def test_invitation_candidates(spark, world):
    users, _, _, members = world
    hits = rel.search_users(users, ["o"]).withColumnRenamed("pattern", "request_id")
    requests = spark.createDataFrame([("o", "c3", "chat--a1--b2")], "request_id string, me string, chat_id string")
    selected = spark.createDataFrame([], "request_id string, user_id string")
    found = rel.invite_candidates(hits, requests, selected, rel.chat_members(members, users))
    assert {r.login for r in found.collect()} == {"ramon2"}
    picked = spark.createDataFrame([("o", "d4")], "request_id string, user_id string")
    assert rel.invite_candidates(hits, requests, picked, rel.chat_members(members, users)).count() == 0
