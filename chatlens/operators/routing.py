"""Sorting a mixed stream of JSON messages by shape.

A message is parsed once, with a schema that holds the fields of all shapes; the shape is then
decided by which required fields are there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.scalars import UUID_TEXT
from chatlens.schemas import CHAT_OFFSETS, INVITATION, MESSAGE, PARTITION_OFFSETS, USER, WRITING

_INBOUND = T.StructType(
    [
        *WRITING.fields,
        T.StructField("user", USER),
        T.StructField("message", MESSAGE),
        T.StructField("me", USER),
        T.StructField("joiningOffset", T.LongType()),
        T.StructField("chats", T.ArrayType(CHAT_OFFSETS)),
        T.StructField("userId", T.StringType()),
        T.StructField("lastMessageTime", T.LongType()),
        T.StructField("partitionOffsets", PARTITION_OFFSETS),
        T.StructField("partitionOffset", PARTITION_OFFSETS),
        T.StructField("sessionId", T.StringType()),
        T.StructField("validityTime", T.LongType()),
    ]
)

# Shapes in the order they are tried; each with the fields it cannot do without. Fixed values.
INBOUND_SHAPES = {
    "writing": ["chatId", "writerId", "writerLogin"],
    "message": [
        "user.userId",
        "user.login",
        "message.content",
        "message.authorId",
        "message.authorLogin",
        "message.sendingTime",
        "message.serverTime",
        "message.zoneId",
        "message.chatId",
        "message.chatName",
        "message.groupChat",
    ],
    "configuration": ["me.userId", "me.login", "joiningOffset", "chats"],
    "chat_offset_update": ["userId", "chatId", "lastMessageTime", "partitionOffsets"],
    "chat_partitions_offsets": ["chatId", "partitionOffset"],
    "session_info": ["sessionId", "userId", "validityTime"],
    "fetch_older": ["chatId"],
}
INBOUND_WORDS = {"PoisonPill": "stop", "ping": "ping"}


def _present(root: str, fields: list[str]) -> Column:
    return reduce(lambda one, other: one & other, [F.col(f"{root}.{name}").isNotNull() for name in fields])


def _first_shape(root: str, shapes: dict[str, list[str]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(_present(root, fields), F.lit(kind)) for kind, fields in shapes.items()], otherwise)


def route_inbound(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``kind`` and the parsed fields as ``parsed``; ``unparsed`` where no shape fits."""
    parsed = messages.withColumn("parsed", F.from_json(F.col(value), _INBOUND))
    words = [F.when(F.col(value) == F.lit(word), F.lit(kind)) for word, kind in INBOUND_WORDS.items()]
    return parsed.withColumn("kind", _first_shape("parsed", INBOUND_SHAPES, F.coalesce(*words, F.lit("unparsed"))))


_OUTBOUND = T.StructType(
    [
        T.StructField("conf", T.StringType()),
        T.StructField("newMsgList", T.ArrayType(MESSAGE)),
        T.StructField("oldMsgList", T.ArrayType(MESSAGE)),
        T.StructField("inv", INVITATION),
        T.StructField("wrt", WRITING),
        T.StructField("comm", T.StringType()),
        T.StructField("num", T.LongType()),
        T.StructField("message", T.StringType()),
    ]
)


def route_outbound(messages: DataFrame, value: str = "value", me: str | None = None) -> DataFrame:
    """Add ``kinds``, every part a client would act on, and the parsed fields.

    Parts are independent, so one message may have several. Somebody's typing is left out
    where that somebody is the column or user ``me``.
    """
    part = F.col("parsed")
    typing = part["wrt"].isNotNull()
    if me is not None:
        typing = typing & ~part["wrt"]["writerId"].eqNullSafe(F.col(me))
    failure = (F.coalesce(part["num"], F.lit(0)) != 0) & (F.length(part["message"]) > 0)
    tests = {
        "new_messages": part["newMsgList"].isNotNull(),
        "old_messages": part["oldMsgList"].isNotNull(),
        "invitation": part["inv"].isNotNull(),
        "writing": typing,
        "opened": part["comm"] == "opened correctly",
        "error": failure,
    }
    kinds = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()]))
    return messages.withColumn("parsed", F.from_json(F.col(value), _OUTBOUND)).withColumn("kinds", kinds)


_COMMAND = T.StructType(
    [
        T.StructField("user", USER),
        T.StructField("message", MESSAGE),
        T.StructField("me", USER),
        T.StructField("users", T.ArrayType(T.StringType())),
        T.StructField("chatName", T.StringType()),
        T.StructField("invitersLogin", T.StringType()),
        T.StructField("partitionOffsets", PARTITION_OFFSETS),
    ]
)

COMMAND_SHAPES = {
    "message": INBOUND_SHAPES["message"],
    "new_chat": ["me.userId", "me.login", "users", "chatName"],
    "new_chat_users": ["invitersLogin", "chatName", "users", "partitionOffsets"],
}


def decode_commands(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``command`` and ``parsed``; a list of users that are not all UUIDs is ``unparsed``."""
    parsed = messages.withColumn("parsed", F.from_json(F.col(value), _COMMAND))
    ids_hold = F.coalesce(
        F.forall("parsed.users", lambda user: F.coalesce(user.rlike(rf"\A{UUID_TEXT}\z"), F.lit(False))), F.lit(True)
    )
    command = _first_shape("parsed", COMMAND_SHAPES, F.lit("unparsed"))
    return parsed.withColumn("command", F.when(ids_hold, command).otherwise(F.lit("unparsed")))
