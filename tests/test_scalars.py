import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens import functions as fn


def values(spark, rows, schema, column):
    return [row[0] for row in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("", 1),
        ("   ", 1),
        ("one", 1),
        ("one two", 2),
        ("one, two, tree,", 3),
        ("a  b", 3),
        ("a\tb\n", 2),
        ("\x00\x1f a \x0b b\x00", 4),
        ("a b", 1),
    ],
)
def test_words_are_pieces_between_single_whitespace(spark, text, words):
    assert values(spark, [(text,)], "t string", fn.count_words("t")) == [words]


def test_a_missing_text_has_no_word_count(spark):
    assert values(spark, [(None,)], "t string", fn.count_words("t")) == [None]


def test_averages_round_ties_to_even_at_two_places(spark):
    rows = [(5, 8), (1, 8), (2, 3), (0, 0), (7, 0), (1, 200), (3, 200), (9_000_000_000_000_000, 1)]
    assert values(spark, rows, "n long, d long", fn.average_text("n", "d")) == [
        "0.62",
        "0.12",
        "0.67",
        "0.00",
        "7.00",
        "0.00",
        "0.02",
        "9000000000000000.00",
    ]


def test_delays_round_away_from_zero_and_may_be_negative(spark):
    assert values(spark, [(2.5,), (-2.5,), (2.4,)], "d double", fn.rounded_ms("d")) == [3, -3, 2]


def test_delay_cuts_both_times_to_milliseconds(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 1_999)
    sent = dt.datetime(2024, 1, 1, 0, 0, 0, 3_001)
    assert values(spark, [(at, sent)], "server_time timestamp, message_time timestamp", fn.delivery_delay_ms()) == [-2]


@pytest.mark.parametrize(
    ("topic", "is_chat"),
    [
        ("chat--541e7401-0000-4000-8000-000000000001--79df5513-0000-4000-8000-000000000002", True),
        ("chat--", True),
        ("chat-x", False),
        ("chat--a b", False),
        ("chat--a\n", False),
        ("my-chat--a", False),
    ],
)
def test_chat_topics(spark, topic, is_chat):
    assert values(spark, [(topic,)], "t string", fn.is_chat_topic("t")) == [is_chat]


@pytest.mark.parametrize(
    ("name", "valid"), [("s", True), ("r 3", True), ("Tatry 2022", True), (" ", False), ("", False), ("a\n", True)]
)
def test_chat_names(spark, name, valid):
    assert values(spark, [(name,)], "n string", fn.is_valid_chat_name("n")) == [valid]


@pytest.mark.parametrize(
    ("login", "invalid"),
    [("Ramon", False), ("ramon", False), ("ę", False), ("ę99", False)]
    + [(bad, True) for bad in ("#", "#exi", "e$xi", "&99", "&9&9", "499", "Ramon#")],
)
def test_logins(spark, login, invalid):
    assert values(spark, [(login,)], "n string", fn.is_invalid_login("n")) == [invalid]


def test_session_tokens_need_three_sound_parts(spark):
    sid, uid = "541E7401-0000-4000-8000-000000000001", "79df5513-0000-4000-8000-000000000002"
    tokens = {
        f"{sid}__{uid}__12": (sid.lower(), uid, 12),
        f"{sid}__{uid}__-12": (sid.lower(), uid, -12),
        f"{sid}__{uid}__12__": (sid.lower(), uid, 12),
        f"{sid}__{uid}": None,
        f"{sid}__{uid}__12__x": None,
        f"{sid}__{uid}__ 12": None,
        f"{sid}__{uid}__99999999999999999999": None,
        f"{sid}__x__12": None,
        "": None,
    }
    rows = spark.createDataFrame([(token,) for token in tokens], "t string").select("t", fn.session_token("t").alias("s"))
    assert {row.t: row.s and tuple(row.s) for row in rows.collect()} == tokens


def test_instants_windows_and_local_clocks(spark):
    row = (
        spark.createDataFrame([(1_711_846_800_000, "Europe/Warsaw")], "ms long, zone string")
        .select(
            fn.instant_text(F.timestamp_millis("ms")),
            fn.window_text(F.timestamp_millis("ms")),
            fn.local_time_text("ms", "zone"),
        )
        .first()
    )
    assert tuple(row) == ("2024-03-31T01:00:00Z", "2024-03-31 01:00:00", "Sunday, 31/03/2024, 03:00:00 GMT+02:00")


def test_clocks_of_unknown_and_western_zones(spark):
    rows = spark.createDataFrame([(0, "Nowhere/Land"), (0, None), (0, "America/St_Johns")], "ms long, zone string")
    got = [row[0] for row in rows.select(fn.local_time_text("ms", "zone")).collect()]
    assert got == [None, None, "Wednesday, 31/12/1969, 20:30:00 GMT-03:30"]


def test_null_text_has_no_words_in_either_mode(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a  b",)], "t string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            assert [row[0] for row in rows.select(fn.count_words("t")).collect()] == [None, 1, 3]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_offsets_round_trip(spark):
    df = spark.createDataFrame([(4, 0, 9)], "o0 long, o1 long, o2 long").select(fn.offsets_array(["o0", "o1", "o2"]).alias("o"))
    assert [tuple(item) for item in df.first().o] == [(0, 4), (1, 0), (2, 9)]
    assert df.select(fn.offset_sum("o")).first()[0] == 13
