"""Routing by variants against a plain decoder that knows the type of every field."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_routing import MESSAGE, PLACES, USER, UUID, frame

from chatlens.operators import routing, variants


def decoded(value, kind, required):
    """Whether a Python value has a type."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return False
        for field in kind.fields:
            inner = {path[len(field.name) + 1 :] for path in required if path.startswith(field.name + ".")}
            own = value.get(field.name)
            if own is None:
                if field.name in required or inner:
                    return False
            elif not decoded(own, field.dataType, inner):
                return False
        return True
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(item is not None and decoded(item, kind.elementType, set()) for item in value)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    limit = 2**31 if isinstance(kind, T.IntegerType) else 2**63
    return isinstance(value, int) and not isinstance(value, bool) and -limit <= value < limit


def first_shape(text, schema, shapes, otherwise):
    try:
        value = json.loads(text)
    except (ValueError, TypeError):
        return otherwise
    for kind, paths in shapes.items():
        names = {path.split(".")[0] for path in paths}
        if decoded(value, T.StructType([f for f in schema.fields if f.name in names]), set(paths)):
            return kind
    return otherwise


GOOD = [
    {"chatId": "c", "writerId": "u", "writerLogin": "l"},
    {"user": USER, "message": MESSAGE},
    {"me": USER, "joiningOffset": 0, "chats": [{"chatId": "c", "partitionOffset": PLACES}]},
    {"userId": "u", "chatId": "c", "lastMessageTime": 1, "partitionOffsets": PLACES},
    {"chatId": "c", "partitionOffset": PLACES},
    {"sessionId": "s", "userId": "u", "validityTime": 1},
    {"me": USER, "users": [UUID], "chatName": "n"},
    {"invitersLogin": "l", "chatName": "n", "users": [], "partitionOffsets": PLACES},
]
WRONG = ["text", "7", 7, 2**40, 2**70, 1.5, True, None, [], [None], ["x"], {}, [{"partition": "0", "offset": 1}], {"userId": 5}]


def changed(draw, value):
    """One field, anywhere, gets a value of another type or goes away."""
    value = copy.deepcopy(value)
    place = value
    while True:
        key = draw.choice(list(place) if isinstance(place, dict) else range(len(place)))
        if isinstance(place[key], (dict, list)) and place[key] and draw.random() < 0.7:
            place = place[key]
            continue
        if draw.random() < 0.2:
            del place[key]
        else:
            place[key] = draw.choice(WRONG)
        return value


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    made = [json.dumps(value) for value in GOOD]
    made += [json.dumps(changed(draw, draw.choice(GOOD))) for _ in range(600)]
    return made + [json.dumps({**a, **b}) for a in GOOD for b in GOOD] + ["{broken", "", "[]", "5", '"text"', "null"]


def test_inbound_and_commands_equal_the_plain_decoder(spark, texts):
    parsed = variants.parse(frame(spark, texts))
    got = variants.decode_commands(variants.route_inbound(parsed)).orderBy("n").collect()
    assert [r.kind for r in got] == [first_shape(t, routing._INBOUND, routing.INBOUND_SHAPES, "unparsed") for t in texts]
    for row, text in zip(got, texts):
        want = first_shape(text, routing._COMMAND, routing.COMMAND_SHAPES, "unparsed")
        assert row.command == want or (row.command == "unparsed" and '"users"' in text)
    assert len({r.kind for r in got}) == 8 and len({r.command for r in got}) == 4


def test_one_field_with_two_types(spark):
    """``message`` is an object from a client, and the text of an error to it; one parse serves both."""
    values = [{"user": USER, "message": MESSAGE}, {"num": 44, "message": "lost"}, {"num": "44", "message": "lost", "comm": "opened correctly"}]
    values += [{"newMsgList": [{**MESSAGE, "sendingTime": "late"}], "inv": {"login": "l"}}, {"chatId": "c", "writerId": 5, "writerLogin": "l"}]
    rows = variants.route_outbound(variants.route_inbound(variants.parse(frame(spark, values)))).orderBy("n").collect()
    assert [r.kind for r in rows] == ["message", "unparsed", "unparsed", "unparsed", "fetch_older"]
    assert [r.kinds for r in rows] == [[], ["error"], ["opened"], ["invitation"], []]


def test_words_and_typed_fields(spark):
    values = ["ping", "PoisonPill", "Ping", None, {"userId": "u", "chatId": "c", "lastMessageTime": 9, "partitionOffsets": PLACES}]
    routed = variants.route_inbound(variants.parse(frame(spark, values))).orderBy("n")
    assert [r.kind for r in routed.collect()] == ["ping", "stop", "unparsed", "unparsed", "chat_offset_update"]
    (row,) = routed.filter("kind = 'chat_offset_update'").select(variants.inbound_fields("chat_offset_update").alias("f")).collect()
    assert (row.f.userId, row.f.lastMessageTime, row.f.partitionOffsets[0].offset) == ("u", 9, 3)


def test_typing_of_oneself_is_left_out(spark):
    writing = {"chatId": "c", "writerLogin": "l"}
    values = [{"wrt": {**writing, "writerId": "me"}}, {"wrt": {**writing, "writerId": "you"}}, {"wrt": writing}]
    parsed = variants.parse(frame(spark, values)).withColumn("me", F.lit("me"))
    assert [r.kinds for r in variants.route_outbound(parsed, "me").orderBy("n").collect()] == [[], ["writing"], ["writing"]]
