"""The per-record grace rule on a live stream.

Spark's watermark moves between batches. Here every key space keeps its own stream time, the largest event
time it has seen, and each record is judged by the stream time at its arrival, however records are
dealt to batches. The state is one number per key space and lives in RocksDB.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from chatlens.streaming.jobs import use_rocksdb
from chatlens.streaming.sinks import to_table


def mark_late(
    messages: DataFrame,
    arrival: str,
    key_space: Sequence[str],
    size_ms: int = 60_000,
    grace_ms: int = 5,
    ts: str = "server_time",
) -> DataFrame:
    """``messages`` with ``stream_time_ms``, ``window_end_ms`` and ``late``, as ``windows.with_lateness`` marks a batch.

    Records of a key space may come in any order inside a batch, they are taken in order of ``arrival``; from batch
    to batch arrivals must not fall. A task holds the records that one key space has in one batch, which the
    source's limit on files or offsets per trigger bounds. Records without a time are neither late nor on time.
    """
    use_rocksdb(messages.sparkSession)
    columns = messages.columns
    added = [T.StructField(name, kind) for name, kind in (
        ("stream_time_ms", T.LongType()), ("window_end_ms", T.LongType()), ("late", T.BooleanType()))]
    schema = T.StructType([*messages.schema.fields, *added])
    marked = Row(*schema.fieldNames())

    # Defined here so that it travels with the task; executors need no copy of this package.
    class StreamTime(StatefulProcessor):
        def init(self, handle):
            self.latest = handle.getValueState("stream_time_ms", "ms long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.latest.get()[0] if self.latest.exists() else None
            now = held
            for row in sorted(rows, key=lambda row: row[arrival]):
                ms, end, late = row["_ts_ms"], None, None
                if ms is not None:
                    now = ms if now is None else max(now, ms)
                    end = ms - ms % size_ms + size_ms
                    late = end + grace_ms <= now
                yield marked(*[row[name] for name in columns], now, end, late)
            if now != held:
                self.latest.update((now,))

        def close(self):
            pass

    timed = messages.withColumn("_ts_ms", F.unix_millis(ts))
    return timed.groupBy(*key_space).transformWithState(StreamTime(), schema, "Append", "None")


def to_kept_and_late(messages: DataFrame, path: str, arrival: str, key_space: Sequence[str], **options) -> DataStreamWriter:
    """Write the stream once, kept and late records side by side; a repeated batch replaces itself."""
    return to_table(mark_late(messages, arrival, key_space, **options).filter(F.col("late").isNotNull()), path)
