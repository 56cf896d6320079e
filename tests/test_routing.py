import json

from chatlens.operators import routing

UUID = "79df5513-0000-4000-8000-000000000002"
USER = {"userId": "u1", "login": "Ramon"}
MESSAGE = {
    "content": "hi",
    "authorId": "u1",
    "authorLogin": "Ramon",
    "sendingTime": 1,
    "serverTime": 0,
    "zoneId": "UTC",
    "chatId": "c",
    "chatName": "n",
    "groupChat": False,
}
PLACES = [{"partition": 0, "offset": 3}]


def frame(spark, values):
    texts = [value if isinstance(value, str) or value is None else json.dumps(value) for value in values]
    return spark.createDataFrame(list(enumerate(texts)), "n int, value string")


def test_inbound_shapes_in_order(spark):
    cases = [
        ({"chatId": "c", "writerId": "u", "writerLogin": "l"}, "writing"),
        ({"user": USER, "message": MESSAGE}, "message"),
        ({"me": USER, "joiningOffset": 0, "chats": []}, "configuration"),
        ({"userId": "u", "chatId": "c", "lastMessageTime": 1, "partitionOffsets": PLACES}, "chat_offset_update"),
        ({"chatId": "c", "partitionOffset": PLACES}, "chat_partitions_offsets"),
        ({"sessionId": "s", "userId": "u", "validityTime": 1}, "session_info"),
        ({"chatId": "c"}, "fetch_older"),
        ("PoisonPill", "stop"),
        ("ping", "ping"),
        ("Ping", "unparsed"),
        ("{broken", "unparsed"),
        ("", "unparsed"),
        (None, "unparsed"),
        # Incomplete shapes fall through to the next one that fits.
        ({"chatId": "c", "writerId": "u"}, "fetch_older"),
        ({"user": USER, "message": {**MESSAGE, "sendingTime": "late"}}, "unparsed"),
        # All fields of two shapes: the one tried first wins.
        ({"chatId": "c", "writerId": "u", "writerLogin": "l", "partitionOffset": PLACES}, "writing"),
    ]
    got = routing.route_inbound(frame(spark, [value for value, _ in cases])).orderBy("n").collect()
    assert [row.kind for row in got] == [kind for _, kind in cases]


def test_outbound_parts(spark):
    writing = {"chatId": "c", "writerId": "u2", "writerLogin": "l"}
    cases = [
        ({"newMsgList": [MESSAGE]}, ["new_messages"]),
        ({"newMsgList": []}, ["new_messages"]),
        ({"oldMsgList": [MESSAGE], "comm": "opened correctly"}, ["old_messages", "opened"]),
        ({"inv": {"login": "l", "chatId": "c"}}, ["invitation"]),
        ({"wrt": writing}, ["writing"]),
        ({"wrt": {**writing, "writerId": "me"}}, []),
        ({"comm": "something"}, []),
        ({"num": 44, "message": "lost"}, ["error"]),
        ({"num": 0, "message": "lost"}, []),
        ({"num": 44, "message": ""}, []),
        ("nonsense", []),
    ]
    messages = frame(spark, [value for value, _ in cases]).selectExpr("*", "'me' as me")
    got = routing.route_outbound(messages, me="me").orderBy("n").collect()
    assert [row.kinds for row in got] == [kinds for _, kinds in cases]


def test_commands(spark):
    cases = [
        ({"user": USER, "message": MESSAGE}, "message"),
        ({"me": USER, "users": [UUID], "chatName": "n"}, "new_chat"),
        ({"me": USER, "users": ["no uuid"], "chatName": "n"}, "unparsed"),
        ({"invitersLogin": "l", "chatName": "n", "users": [], "partitionOffsets": PLACES}, "new_chat_users"),
        ({"invitersLogin": "l", "users": []}, "unparsed"),
    ]
    got = routing.decode_commands(frame(spark, [value for value, _ in cases])).orderBy("n").collect()
    assert [row.command for row in got] == [command for _, command in cases]
