"""Schemas of the chat log, the control messages and the relational tables."""

from __future__ import annotations

from pyspark.sql import types as T

PARTITION_OFFSET = T.StructType(
    [T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())]
)
PARTITION_OFFSETS = T.ArrayType(PARTITION_OFFSET)

USER = T.StructType([T.StructField("userId", T.StringType()), T.StructField("login", T.StringType())])

MESSAGE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("authorId", T.StringType()),
        T.StructField("authorLogin", T.StringType()),
        T.StructField("sendingTime", T.LongType()),
        T.StructField("serverTime", T.LongType()),
        T.StructField("zoneId", T.StringType()),
        T.StructField("chatId", T.StringType()),
        T.StructField("chatName", T.StringType()),
        T.StructField("groupChat", T.BooleanType()),
        T.StructField("partOff", PARTITION_OFFSET),
    ]
)

INVITATION = T.StructType(
    [
        T.StructField("login", T.StringType()),
        T.StructField("toUserId", T.StringType()),
        T.StructField("chatName", T.StringType()),
        T.StructField("chatId", T.StringType()),
        T.StructField("sendingTime", T.LongType()),
        T.StructField("serverTime", T.LongType()),
        T.StructField("myJoiningOffset", T.LongType()),
        T.StructField("partitionOffsets", PARTITION_OFFSETS),
    ]
)

WRITING = T.StructType(
    [
        T.StructField("chatId", T.StringType()),
        T.StructField("writerId", T.StringType()),
        T.StructField("writerLogin", T.StringType()),
    ]
)

CHAT_OFFSETS = T.StructType(
    [T.StructField("chatId", T.StringType()), T.StructField("partitionOffset", PARTITION_OFFSETS)]
)

# One log record as the broker hands it over.
ENVELOPE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# The analytic row every metric is computed from.
CHAT_MESSAGE = T.StructType(
    [
        T.StructField("server_time", T.TimestampType()),
        T.StructField("chat_id", T.StringType()),
        T.StructField("chat_name", T.StringType()),
        T.StructField("group_chat", T.BooleanType()),
        T.StructField("zone_id", T.StringType()),
        T.StructField("message_time", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("login", T.StringType()),
    ]
)
