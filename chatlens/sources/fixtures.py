"""Chat data derived from the sample tables, for tests, queries and the benchmark.

Each function gives one of the frames the operators take. ``catalog.fixture_sql`` has the same
definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.sources.tables import parquet_table

OFFSETS = ["users_offset_0", "users_offset_1", "users_offset_2"]
NOW_MS = 1_705_276_800_000  # 2024-01-15T00:00Z

# Zone of the sender by kind of event.
ZONES = {
    "click": "Europe/Warsaw",
    "view": "Europe/Paris",
    "purchase": "UTC",
    "signup": "America/New_York",
    "error": "Asia/Tokyo",
}
SETTINGS_ZONES = ["UTC", "Europe/Warsaw", "Europe/Paris", "America/New_York", "Asia/Tokyo"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return parquet_table(spark, f"{sf}/{name}.parquet")


def by_value(column: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == key, F.lit(value)) for key, value in mapping.items()])


def _chat(number: str) -> Column:
    return F.concat(F.lit("chat--"), F.col(number).cast("string"))


def delay_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages with a send and a receive time."""
    events = table(spark, sf, "events")
    sent_us = F.unix_micros("ts") - F.floor("value") * 1000
    return events.select(
        F.col("ts").alias("server_time"),
        F.concat(F.lit("chat--"), (F.col("user_id") % 20).cast("string")).alias("chat_id"),
        F.concat(F.lit("Chat "), (F.col("user_id") % 20).cast("string")).alias("chat_name"),
        (F.col("user_id") % 2 == 1).alias("group_chat"),
        by_value(F.col("event_type"), ZONES).alias("zone_id"),
        F.timestamp_micros(sent_us).alias("message_time"),
        F.col("props").alias("content"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("login"),
        F.col("event_id").alias("arrival"),
    )


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """The same messages as log records; errors go to topics that are no chats."""
    events = delay_messages(spark, sf)
    message = F.struct(
        "content",
        F.col("user_id").alias("authorId"),
        F.col("login").alias("authorLogin"),
        F.unix_millis("message_time").alias("sendingTime"),
        F.lit(0).cast("long").alias("serverTime"),
        F.col("zone_id").alias("zoneId"),
        F.col("chat_id").alias("chatId"),
        F.col("chat_name").alias("chatName"),
        F.col("group_chat").alias("groupChat"),
    )
    topic = F.when(F.col("zone_id") == ZONES["error"], F.concat(F.lit("writing "), F.col("chat_id")))
    return events.select(
        F.to_json(F.struct(F.col("user_id").alias("userId"), "login")).cast("binary").alias("key"),
        F.to_json(message).cast("binary").alias("value"),
        F.coalesce(topic, F.col("chat_id")).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("arrival").alias("offset"),
        F.col("server_time").alias("timestamp"),
    )


def word_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations: few authors, many chats."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.col("conv_id") * 20 + F.col("turn") * 7
    return table(spark, sf, "conversations").select(
        F.timestamp_seconds(F.unix_seconds(start) + seconds).alias("server_time"),
        F.col("conv_id").cast("string").alias("chat_id"),
        F.col("role").alias("user_id"),
        F.col("text").alias("content"),
        by_value(
            F.col("role"), {"system": "UTC", "user": "Europe/Warsaw", "assistant": "Europe/Paris"}
        ).alias("zone_id"),
    )


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts in few chats and zones."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf, "documents").select(
        F.timestamp_seconds(F.unix_seconds(start) + F.col("doc_id") * 3).alias("server_time"),
        F.col("source").alias("chat_id"),
        (F.col("doc_id") % 50).cast("string").alias("user_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("zone_id"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        F.col("s_suppkey").alias("user_num_id"),
        F.col("s_name").alias("login"),
    )


def settings(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.element_at(F.array(*[F.lit(name) for name in SETTINGS_ZONES]), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("user_id"),
        (F.col("s_suppkey") % 50 * 1000).alias("joining_offset"),
        F.lit(900_000).cast("long").alias("session_duration"),
        zone.alias("zone_id"),
    )


def profile_users(spark: SparkSession, sf: str) -> DataFrame:
    """The users, and every customer as a user without chats."""
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user_id"),
        (F.col("c_custkey") + 1_000_000).alias("user_num_id"),
        F.col("c_name").alias("login"),
    )
    return users(spark, sf).unionByName(customers)


def profile_settings(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user_id"),
        F.lit(0).cast("long").alias("joining_offset"),
        F.lit(900_000).cast("long").alias("session_duration"),
        F.lit("UTC").alias("zone_id"),
    )
    return settings(spark, sf).unionByName(customers)


def users_chats(spark: SparkSession, sf: str) -> DataFrame:
    """One membership per order and supplier; a position counts the supplier's own lines."""
    lines = table(spark, sf, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.unix_millis(F.max("l_shipdate")).alias("message_time"),
        *[F.count_if(F.col("l_linenumber") % 3 == part).alias(name) for part, name in enumerate(OFFSETS)],
    )
    return rows.select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        _chat("l_orderkey").alias("chat_id"),
        F.concat(F.lit("Chat "), F.col("l_orderkey").cast("string")).alias("chat_name"),
        "message_time",
        (F.col("l_suppkey") % 7 == 0).alias("silent"),
        *OFFSETS,
    )


def chats(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    sizes = members.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("members"))
    return sizes.select(_chat("l_orderkey").alias("chat_id"), (F.col("members") > 2).alias("group_chat"))


def message_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log with three partitions per chat and offsets without gaps."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") % 3).alias("partition"),
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        "l_extendedprice",
        "l_shipdate",
    )
    # An order has a handful of lines at any scale, so one window row number is enough.
    order = Window.partitionBy("l_orderkey", "partition").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    placed = lines.withColumn("_position", F.row_number().over(order))
    return placed.select(
        _chat("l_orderkey").alias("chat_id"),
        "partition",
        (F.col("_position") - 1).cast("long").alias("offset"),
        F.col("l_shipdate").alias("server_time"),
        F.col("l_suppkey").cast("string").alias("author_id"),
        F.col("l_partkey").cast("string").alias("content"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.unix_millis("ts") + 900_000).alias("validity_time"),
    )


def invitations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers are invited to a chat per part they ship; offsets rise with the order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset"),
        _chat("l_partkey").alias("chat_id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" "), F.col("l_returnflag")).alias("chat_name"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_linenumber").cast("string"), 9, "0")).alias("login"),
    )


def offset_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Clients reporting positions, several per membership, not always rising."""
    lines = table(spark, sf, "lineitem")
    reported = [
        (F.col("l_quantity").cast("long") % 7),
        F.round(F.col("l_discount") * 100).cast("long"),
        (F.col("l_partkey") % 5),
    ]
    return lines.select(
        F.col("l_suppkey").cast("string").alias("user_id"),
        _chat("l_orderkey").alias("chat_id"),
        F.unix_millis("l_shipdate").alias("last_message_time"),
        F.array(
            *[F.struct(F.lit(part).alias("partition"), value.alias("offset")) for part, value in enumerate(reported)]
        ).alias("partition_offsets"),
        # Unique per membership: line, part and price tell its lines apart.
        (
            F.col("l_linenumber").cast("decimal(38,0)") * 10**18
            + F.col("l_partkey").cast("decimal(38,0)") * 10**9
            + F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
        ).cast("decimal(38,0)").alias("arrival"),
    )


def writing(spark: SparkSession, sf: str) -> DataFrame:
    return delay_messages(spark, sf).select(
        "server_time", "chat_id", F.col("user_id").alias("writer_id"), F.col("login").alias("writer_login")
    )


def shipment_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A property graph: suppliers to the numbers of the parts they ship."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation")
    )


def _user_json() -> Column:
    return F.struct(F.col("user_id").alias("userId"), F.col("login"))


def _offsets_json() -> Column:
    return F.array(F.struct(F.lit(0).alias("partition"), F.col("arrival").alias("offset")))


def _message_json() -> Column:
    return F.struct(
        F.col("content"),
        F.col("user_id").alias("authorId"),
        F.col("login").alias("authorLogin"),
        F.unix_millis("message_time").alias("sendingTime"),
        F.unix_millis("server_time").alias("serverTime"),
        F.col("zone_id").alias("zoneId"),
        F.col("chat_id").alias("chatId"),
        F.col("chat_name").alias("chatName"),
        F.col("group_chat").alias("groupChat"),
    )


def _mixed(events: DataFrame, shapes: list[Column]) -> DataFrame:
    which = (F.col("arrival") % len(shapes)).cast("int")
    value = F.coalesce(*[F.when(which == index, shape) for index, shape in enumerate(shapes)])
    return events.select("arrival", F.col("user_id"), value.alias("value"))


def inbound_json(spark: SparkSession, sf: str) -> DataFrame:
    """Everything a client sends, mixed."""
    chat, user = F.col("chat_id").alias("chatId"), F.col("user_id").alias("userId")
    writing_ = F.struct(chat, F.col("user_id").alias("writerId"), F.col("login").alias("writerLogin"))
    chats_ = F.array(F.struct(chat, _offsets_json().alias("partitionOffset")))
    return _mixed(
        delay_messages(spark, sf),
        [
            F.to_json(writing_),
            F.to_json(F.struct(_user_json().alias("user"), _message_json().alias("message"))),
            F.to_json(F.struct(_user_json().alias("me"), F.col("arrival").alias("joiningOffset"), chats_.alias("chats"))),
            F.to_json(
                F.struct(
                    user,
                    chat,
                    F.unix_millis("server_time").alias("lastMessageTime"),
                    _offsets_json().alias("partitionOffsets"),
                )
            ),
            F.to_json(F.struct(chat, _offsets_json().alias("partitionOffset"))),
            F.to_json(F.struct(F.lit("s").alias("sessionId"), user, F.col("arrival").alias("validityTime"))),
            F.to_json(F.struct(chat)),
            F.lit("ping"),
            F.lit("PoisonPill"),
            F.concat(F.lit("{not json "), F.col("content")),
            F.to_json(F.struct(F.col("login").alias("somethingElse"))),
        ],
    )


def outbound_json(spark: SparkSession, sf: str) -> DataFrame:
    """Everything a client receives, mixed."""
    writing_ = F.struct(
        F.col("chat_id").alias("chatId"), F.col("user_id").alias("writerId"), F.col("login").alias("writerLogin")
    )
    other = F.struct(F.col("chat_id").alias("chatId"), F.lit("x").alias("writerId"), F.col("login").alias("writerLogin"))
    invitation = F.struct("login", F.col("user_id").alias("toUserId"), F.col("chat_id").alias("chatId"))
    return _mixed(
        delay_messages(spark, sf),
        [
            F.to_json(F.struct(F.array(_message_json()).alias("newMsgList"))),
            F.to_json(F.struct(F.array(_message_json()).alias("oldMsgList"))),
            F.to_json(F.struct(invitation.alias("inv"))),
            F.to_json(F.struct(writing_.alias("wrt"))),
            F.to_json(F.struct(other.alias("wrt"))),
            F.to_json(F.struct(F.lit("opened correctly").alias("comm"))),
            F.to_json(F.struct((F.col("arrival") % 3).alias("num"), F.col("login").alias("message"))),
        ],
    )


def command_json(spark: SparkSession, sf: str) -> DataFrame:
    """Commands sent to the service, mixed; some with malformed user ids."""
    digest = F.md5("user_id")
    uuid = F.concat_ws("-", *[F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    good, bad = F.array(uuid), F.array(uuid, F.col("user_id"))
    return _mixed(
        delay_messages(spark, sf),
        [
            F.to_json(F.struct(_user_json().alias("user"), _message_json().alias("message"))),
            F.to_json(F.struct(_user_json().alias("me"), good.alias("users"), F.col("chat_name").alias("chatName"))),
            F.to_json(F.struct(_user_json().alias("me"), bad.alias("users"), F.col("chat_name").alias("chatName"))),
            F.to_json(
                F.struct(
                    F.col("login").alias("invitersLogin"),
                    F.col("chat_name").alias("chatName"),
                    good.alias("users"),
                    _offsets_json().alias("partitionOffsets"),
                )
            ),
            F.to_json(F.struct(F.col("login").alias("invitersLogin"), good.alias("users"))),
        ],
    )


def session_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Session tokens, well formed and not."""

    def as_uuid(digest: Column) -> Column:
        pieces = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in pieces])

    session, user = as_uuid(F.md5("session_id")), as_uuid(F.md5("user_id"))
    time = F.col("validity_time").cast("string")
    shapes = [
        F.concat(session, F.lit("__"), user, F.lit("__"), time),
        F.concat(session, F.lit("__"), user),
        F.concat(session, F.lit("__"), F.col("user_id"), F.lit("__"), time),
        F.concat(session, F.lit("__"), user, F.lit("__"), time, F.lit("x")),
        F.concat(session, F.lit("__"), user, F.lit("__"), time, F.lit("__")),
    ]
    return _mixed_tokens(sessions(spark, sf), shapes)


def _mixed_tokens(rows: DataFrame, shapes: list[Column]) -> DataFrame:
    which = (F.col("session_id").cast("long") % len(shapes)).cast("int")
    token = F.coalesce(*[F.when(which == index, shape) for index, shape in enumerate(shapes)])
    return rows.select("session_id", token.alias("token"))


def direct_chats(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of direct chats: the supplier first or second, by the line's order."""
    lines = table(spark, sf, "lineitem")
    swap = F.col("l_linenumber") % 2 == 1
    supplier, other = F.col("l_suppkey").cast("string"), (F.col("l_partkey") + 1_000_000).cast("string")
    return lines.select(
        F.concat(
            F.lit("chat--"), F.when(swap, supplier).otherwise(other), F.lit("--"), F.when(swap, other).otherwise(supplier)
        ).alias("chat_id")
    ).distinct()


def wanted_logins(spark: SparkSession, sf: str) -> DataFrame:
    """Logins and ids to look up, some of which belong to nobody."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.concat(F.lit("Supplier#"), F.substring("c_name", 10, 9)).alias("login"),
    )


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Names as people type them: parts, brands, customers, segments."""
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    columns = [part["p_name"], part["p_brand"], F.col("p_size").cast("string")]
    typed = [part.select(column.alias("name")) for column in columns]
    typed += [customer.select(customer[name].alias("name")) for name in ("c_name", "c_mktsegment")]
    result = typed[0]
    for more in typed[1:]:
        result = result.unionAll(more)
    return result.distinct()
