"""Running streams: one checkpoint per query, emission modes, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Emission:
    """When a windowed result leaves the stream."""

    CLOSED = "append"  # once, after the watermark passed the window's end
    EVERY_CHANGE = "update"  # after each batch that touched the window


def start(writer: DataStreamWriter, name: str, checkpoints: str, every: str | None = None, once: bool = False) -> StreamingQuery:
    """Start a query under its own checkpoint folder.

    ``every`` is the trigger interval; ``once`` processes what is there and stops.
    """
    if every:
        writer = writer.trigger(processingTime=every)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.queryName(name).option("checkpointLocation", f"{checkpoints}/{name}").start()


def run_available(writer: DataStreamWriter, name: str, checkpoints: str) -> None:
    """Process everything available and wait for the end."""
    start(writer, name, checkpoints, once=True).awaitTermination()


def use_rocksdb(spark) -> None:
    """Keep window state off the heap, for state larger than executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def counted(df: DataFrame, name: str, ts: str = "server_time") -> DataFrame:
    """Report rows and the latest time of each batch as query metrics, instead of logging rows."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.max(ts).alias("latest"))
