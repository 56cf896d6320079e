"""The chat log: one topic per chat, read as a stream or as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions import is_chat_topic
from chatlens.functions.scalars import CHAT_TOPIC
from chatlens.schemas import ENVELOPE, MESSAGE


def chat_log(spark: SparkSession, servers: str, streaming: bool = True, **options: str) -> DataFrame:
    """Envelopes of every chat topic, also of topics created later. Needs the Kafka connector."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribePattern", CHAT_TOPIC)
    return reader.options(**options).load().select(*ENVELOPE.fieldNames())


def chat_log_files(spark: SparkSession, path: str, streaming: bool = True, files_per_batch: int | None = None) -> DataFrame:
    """The same envelopes from a folder of parquet files (an exported log)."""
    reader = (spark.readStream if streaming else spark.read).schema(ENVELOPE)
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return chat_records(reader.parquet(path))


def chat_records(envelopes: DataFrame) -> DataFrame:
    """The envelopes of chat topics."""
    return envelopes.filter(is_chat_topic("topic"))


def _parsed(envelopes: DataFrame) -> DataFrame:
    return envelopes.withColumn("_m", F.from_json(F.col("value").cast("string"), MESSAGE))


def decode_messages(envelopes: DataFrame) -> DataFrame:
    """Envelopes as analytic rows: receive time from the broker, send time from the message."""
    message = F.col("_m")
    return _parsed(envelopes).select(
        F.col("timestamp").alias("server_time"),
        message["chatId"].alias("chat_id"),
        message["chatName"].alias("chat_name"),
        message["groupChat"].alias("group_chat"),
        message["zoneId"].alias("zone_id"),
        F.timestamp_millis(message["sendingTime"]).alias("message_time"),
        message["content"].alias("content"),
        message["authorId"].alias("user_id"),
        message["authorLogin"].alias("login"),
    )


def enrich_from_envelope(envelopes: DataFrame) -> DataFrame:
    """Message fields with the broker's time, partition and offset in place of the sender's."""
    message = F.col("_m")
    kept = [name for name in MESSAGE.fieldNames() if name not in ("serverTime", "partOff")]
    return _parsed(envelopes).select(
        *[message[name].alias(name) for name in kept],
        F.unix_millis("timestamp").alias("serverTime"),
        F.struct(F.col("partition"), F.col("offset")).alias("partOff"),
    )
