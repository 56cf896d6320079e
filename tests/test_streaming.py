"""Streams against batch results: parity, emission, restart, late data, sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chatlens.operators import windows
from chatlens.operators.encode import log_record
from chatlens.schemas import CHAT_MESSAGE, ENVELOPE
from chatlens.sources import chat_log_files, decode_messages
from chatlens.streaming import latest_rows, run_available, start, to_csv, to_table, to_versions
from chatlens.streaming.jobs import counted, use_rocksdb

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def envelope(ms, user="u1", content="one two", topic="chat--a", delay=5, zone="UTC"):
    at = START + dt.timedelta(milliseconds=ms)
    message = {
        "content": content,
        "authorId": user,
        "authorLogin": f"login {user}",
        "sendingTime": int(at.timestamp() * 1000) - delay,
        "serverTime": 0,
        "zoneId": zone,
        "chatId": topic,
        "chatName": "n",
        "groupChat": False,
    }
    return (b"k", json.dumps(message).encode(), topic, 0, ms, at)


class Log:
    """A folder of envelope files, read in the order they were added."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.added = spark, str(folder), 0

    def add(self, *records):
        self.added += 1
        frame = self.spark.createDataFrame(list(records), ENVELOPE).coalesce(1)
        frame.write.mode("append").parquet(self.folder)

    def stream(self):
        return decode_messages(chat_log_files(self.spark, self.folder, files_per_batch=1))

    def batch(self):
        return decode_messages(chat_log_files(self.spark, self.folder, streaming=False))


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path / "log")


def rows(df):
    return {tuple(row) for row in df.collect()}


def test_topics_are_filtered_and_messages_decoded(log):
    log.add(envelope(0), envelope(1, topic="writing--a"), envelope(2, topic="chat--b c"))
    assert log.batch().schema == CHAT_MESSAGE
    (row,) = log.batch().collect()
    assert (row.user_id, row.login, row.chat_id, row.content) == ("u1", "login u1", "chat--a", "one two")
    assert (row.server_time - row.message_time) == dt.timedelta(milliseconds=5)


def test_closed_windows_equal_the_batch_without_the_open_tail(spark, log, tmp_path):
    for minute in range(6):
        log.add(*[envelope(minute * 60_000 + second * 1000, f"u{second % 3}", delay=second) for second in range(0, 60, 7)])
    result = windows.avg_delay_by_user(log.stream())
    run_available(to_table(result, str(tmp_path / "out")), "delay", str(tmp_path / "checkpoints"))
    got = spark.read.parquet(str(tmp_path / "out")).select(*result.columns)
    latest = log.batch().agg(F.max("server_time")).first()[0]
    batch = windows.avg_delay_by_user(log.batch())
    closed = batch.filter(F.col("window_end") <= F.lit(latest) - F.expr("interval 30 seconds"))
    assert rows(got) == rows(closed) and got.count() == closed.count() < batch.count()


def test_updates_end_in_the_batch_result(spark, log, tmp_path):
    for part in range(4):
        log.add(*[envelope(part * 25_000 + i * 900, f"u{i % 2}", "w " * (i + 1)) for i in range(20)])
    result = windows.split_window(windows.avg_words_windowed(log.stream(), "user_id"))
    run_available(to_versions(result, str(tmp_path / "out")), "words", str(tmp_path / "checkpoints"))
    versions = spark.read.parquet(str(tmp_path / "out"))
    got = latest_rows(spark, str(tmp_path / "out"), result.schema, ["window_start", "window_end", "user_id"])
    assert rows(got) == rows(windows.split_window(windows.avg_words_windowed(log.batch(), "user_id")))
    assert versions.count() > got.count()


def test_two_runs_on_one_checkpoint_equal_one_run(spark, log, tmp_path):
    def run(out, checkpoints):
        result = windows.split_window(windows.avg_words_windowed(log.stream(), "user_id"))
        run_available(to_versions(result, str(tmp_path / out)), "words", str(tmp_path / checkpoints))
        return latest_rows(spark, str(tmp_path / out), result.schema, ["window_start", "window_end", "user_id"])

    log.add(*[envelope(i * 1000, content="a b") for i in range(50)])
    run("twice", "first")
    log.add(*[envelope(50_000 + i * 1000, content="a b c") for i in range(50)])
    assert rows(run("twice", "first")) == rows(run("once", "second"))


def test_a_batch_run_twice_is_stored_once(spark, log, tmp_path):
    log.add(*[envelope(i) for i in range(5)])
    run_available(to_table(log.stream(), str(tmp_path / "out")), "rows", str(tmp_path / "checkpoints"))
    # Forgetting that the batch was finished makes a restart repeat it.
    for path in (tmp_path / "checkpoints" / "rows" / "commits").iterdir():
        path.unlink()
    run_available(to_table(log.stream(), str(tmp_path / "out")), "rows", str(tmp_path / "checkpoints"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_records_behind_the_watermark_are_dropped(spark, log, tmp_path):
    log.add(envelope(0), envelope(100))
    log.add(envelope(70_000))
    log.add(envelope(70_500))  # lateness is judged by the watermark two batches back
    log.add(envelope(200), envelope(71_000))
    result = windows.split_window(windows.avg_words_windowed(log.stream(), "user_id"))
    run_available(to_versions(result, str(tmp_path / "out")), "words", str(tmp_path / "checkpoints"))
    got = latest_rows(spark, str(tmp_path / "out"), result.schema, ["window_start", "window_end", "user_id"])
    assert {row.window_start.minute: row.messages for row in got.collect()} == {0: 2, 1: 3}


def test_keyed_changes_as_records(spark, log, tmp_path):
    log.add(envelope(0, "u1", "a b"), envelope(1, "u1", "a"))
    log.add(envelope(2, "u1", "a"))
    pairs = windows.keyed_result(windows.avg_words_windowed(log.stream(), "user_id"), "user_id", "avg_words")
    run_available(to_versions(pairs, str(tmp_path / "out")), "pairs", str(tmp_path / "checkpoints"))
    versions = spark.read.parquet(str(tmp_path / "out")).orderBy("batch_id").collect()
    assert [row.value for row in versions] == ["1.50", "1.33"]
    assert {row.key for row in versions} == {"2024-01-01T00:00:00Z___u1"}


def test_rows_as_log_records(spark, log, tmp_path):
    log.add(*[envelope(i * 20_000) for i in range(12)])
    records = log_record(windows.num_messages(log.stream()))
    run_available(to_table(records, str(tmp_path / "out")), "records", str(tmp_path / "checkpoints"))
    values = [json.loads(row.value) for row in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {"window_start": "2024-01-01T00:00:00.000Z", "window_end": "2024-01-01T00:01:00.000Z", "num_of_messages_per_time": 3} in values


def test_csv_sink(spark, log, tmp_path):
    log.add(*[envelope(i * 20_000) for i in range(12)])
    result = windows.avg_delay_by_zone(log.stream())
    run_available(to_csv(result, str(tmp_path / "csv")), "csv", str(tmp_path / "checkpoints"))
    text = "\n".join(path.read_text() for path in (tmp_path / "csv").glob("part-*.csv"))
    assert "window_start||window_end||zone_id||avg_diff_time_ms" in text and "||UTC||5.0" in text


def test_every_query_has_its_own_checkpoint_and_metrics(spark, log, tmp_path):
    log.add(*[envelope(i * 20_000) for i in range(6)])
    seen = counted(log.stream(), "traffic")
    for name in ("one", "two"):
        query = start(to_table(seen, str(tmp_path / name)), name, str(tmp_path / "checkpoints"), once=True)
        query.awaitTermination()
        assert [p.observedMetrics["traffic"].rows for p in query.recentProgress if p.numInputRows] == [6]
    assert sorted(path.name for path in (tmp_path / "checkpoints").iterdir()) == ["one", "two"]


def test_state_in_rocksdb(spark, log, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_rocksdb(spark)
    try:
        log.add(*[envelope(i * 20_000) for i in range(12)])
        result = windows.num_messages(log.stream())
        run_available(to_table(result, str(tmp_path / "out")), "rocks", str(tmp_path / "checkpoints"))
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
