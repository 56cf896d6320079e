import datetime as dt
import random

from pyspark.sql import functions as F

from chatlens.operators import encode, windows

START = dt.datetime(2024, 1, 1)
WARSAW, PARIS = "Europe/Warsaw", "Europe/Paris"


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def messages(spark, rows):
    """rows of (ms, user, zone, chat, group chat, content, delay)"""
    data = [(at(ms), u, z, c, g, t, at(ms - d) if d is not None else None) for ms, u, z, c, g, t, d in rows]
    return spark.createDataFrame(
        data,
        "server_time timestamp, user_id string, zone_id string, chat_id string, group_chat boolean, content string, "
        "message_time timestamp",
    )


def counts(df, key):
    return {(row.window_start, row[key]): row.messages for row in df.collect()}


def test_counts_per_zone(spark):
    rows = [(0, "1", WARSAW, "", False, "", 0), (0, "2", PARIS, "", False, "", 0), (0, "2", PARIS, "", False, "", 0)]
    got = counts(windows.msg_count(messages(spark, rows), "zone_id", "1 second", "0 seconds"), "zone_id")
    assert got == {(START, WARSAW): 1, (START, PARIS): 2}


def test_counts_per_user_with_a_later_record(spark):
    rows = [(0, "1", WARSAW, "", False, "", 0), (0, "2", PARIS, "", False, "", 0), (3_000, "2", PARIS, "", False, "", 0)]
    got = counts(windows.msg_count(messages(spark, rows), "user_id", "2 seconds", "5 seconds"), "user_id")
    assert got == {(START, "1"): 1, (START, "2"): 1, (at(2_000), "2"): 1}


def test_counts_out_of_order_in_total_and_by_kind(spark):
    rows = [(ms, "1", WARSAW, "Chat1", ms > 300, "", 0) for ms in (0, 0, 390, 350, 30, 10_030)]
    log = messages(spark, rows)
    assert {row.window_start: row.messages for row in windows.msg_count(log).collect()} == {START: 5, at(10_000): 1}
    assert counts(windows.msg_count(log, windows.chat_type()), "chat_type") == {
        (START, 0): 3,
        (START, 1): 2,
        (at(10_000), 1): 1,
    }


def test_a_record_on_the_half_minute_is_in_two_windows(spark):
    log = messages(spark, [(30_000, "1", PARIS, "", False, "", 5), (30_500, None, PARIS, "", False, "", -3)])
    got = {tuple(row) for row in windows.avg_delay_by_user(log).collect()}
    assert got == {
        (at(0), at(60_000), "1", 5.0),
        (at(30_000), at(90_000), "1", 5.0),
        (at(0), at(60_000), None, -3.0),
        (at(30_000), at(90_000), None, -3.0),
    }
    assert [tuple(row) for row in windows.avg_delay(log).orderBy("window_start").collect()] == [
        ("2024-01-01 00:00:00", "2024-01-01 00:01:00", 1.0),
        ("2024-01-01 00:00:30", "2024-01-01 00:01:30", 1.0),
    ]


def test_average_words_over_everything(spark):
    rows = [(0, "1", WARSAW, "", False, "one, two, tree,", 0), (1, "1", WARSAW, "", False, "one, two, tree,", 0)]
    rows += [(ms, "2", PARIS, "", False, text, 0) for ms, text in enumerate(["one", "one two", "one two"])]
    got = {row.user_id: row.avg_words for row in windows.avg_words(messages(spark, rows), "user_id").collect()}
    assert got == {"1": "3.00", "2": "1.67"}


def test_average_words_per_window_as_text_pairs(spark):
    rows = [(0, "1", WARSAW, "Chat1", False, "a b", 0), (59_999, "2", WARSAW, "Chat2", False, "a", 0)]
    rows += [(60_000, "2", WARSAW, "Chat2", False, None, 0)]
    pairs = windows.keyed_result(windows.avg_words_windowed(messages(spark, rows), "zone_id"), "zone_id", "avg_words")
    assert {tuple(row) for row in pairs.collect()} == {
        ("2024-01-01T00:00:00Z___Europe/Warsaw", "1.50"),
        ("2024-01-01T00:01:00Z___Europe/Warsaw", "0.00"),
    }


def replay(records, size, grace):
    """The grace rule, record by record."""
    latest, late = {}, set()
    for arrival, space, ms in records:
        latest[space] = max(latest.get(space, ms), ms)
        if ms - ms % size + size + grace <= latest[space]:
            late.add(arrival)
    return late


def test_lateness_equals_a_replay(spark):
    rng = random.Random(3)
    records = [(i, "hot" if rng.random() < 0.6 else rng.choice("ab"), i * 40 + rng.randrange(-4_000, 4_000) + 10**12) for i in range(500)]
    log = spark.createDataFrame(
        [(i, space, START + dt.timedelta(milliseconds=ms - 10**12)) for i, space, ms in records],
        "arrival long, space string, server_time timestamp",
    )
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    absolute = [(i, space, ms - 10**12 + base) for i, space, ms in records]
    for keys, spaces in ((["space"], absolute), ([], [(i, "", ms) for i, _, ms in absolute])):
        options = dict(key_space=keys, size_ms=2_000, grace_ms=250, rows_per_block=16, blocks_per_span=5)
        late = windows.late_records(log, "arrival", **options)
        want = replay(spaces, 2_000, 250)
        assert want and {row.arrival for row in late.collect()} == want
        kept = windows.on_time(log, "arrival", **options)
        assert kept.columns == log.columns and kept.count() == 500 - len(want)


def test_rows_with_a_wrong_group_are_set_apart(spark):
    rows = spark.createDataFrame([("Europe/Paris",), ("Mars/Base",), (None,)], "zone_id string")
    fine, wrong = encode.checked_results(rows, "zone_id", "zone")
    assert [r.zone_id for r in fine.collect()] == ["Europe/Paris"] and wrong.count() == 2
    ids = spark.createDataFrame([("541e7401-957f-4d2c-a4b0-2d0b1f1f1f1f",), ("7",)], "user_id string")
    assert [part.count() for part in encode.checked_results(ids, "user_id", "uuid")] == [1, 1]


def test_result_records(spark):
    log = messages(spark, [(0, "1", PARIS, "", False, "", 2), (1, "1", PARIS, "", False, "", 3)])
    delays = windows.avg_delay_by_zone(log).filter(F.col("window_start") == F.lit(START))
    row = encode.encode_delay(delays, "zone_id").first()
    assert row.key is None
    assert row.value.decode() == (
        '{"window_start":"2024-01-01T00:00:00Z","window_end":"2024-01-01T00:01:00Z","zone_id":"Europe/Paris","delay_ms":3}'
    )


def test_a_group_that_is_no_uuid_fails_where_one_is_due(spark):
    delays = windows.avg_delay_by_user(messages(spark, [(0, "1", PARIS, "", False, "", 2)]))
    try:
        encode.encode_delay(delays, "user_id", uuid_group=True).collect()
    except Exception as error:
        assert "not a UUID" in str(error)
    else:
        raise AssertionError("accepted")
