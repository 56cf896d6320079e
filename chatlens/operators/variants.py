"""Sorting mixed JSON messages by shape, with one parse for all routers.

A message is parsed to a ``VARIANT`` without a schema. A shape fits where its required fields are there and every
field it names has its type, so a field of another type rules that shape out and no other; in
``routing``, which parses by one schema, a field has one type for all shapes and numbers pass for text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.scalars import UUID_TEXT
from chatlens.operators.routing import _COMMAND, _INBOUND, _OUTBOUND, COMMAND_SHAPES, INBOUND_SHAPES, INBOUND_WORDS

JSON = "json"


def parse(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``json``; null where the text is no JSON, or names a field twice."""
    return messages.withColumn(JSON, F.try_parse_json(value))


def _field(held: Column, name: str) -> Column:
    return F.try_variant_get(held, f"$.{name}", "variant")


def fits(held: Column, kind: T.DataType, required: frozenset[str] = frozenset()) -> Column:
    """Whether a variant has this type, without any conversion; ``required`` names fields, by their path, that must be there."""
    written = F.schema_of_variant(held)
    if isinstance(kind, T.StructType):
        tests = [written.startswith("OBJECT<")]
        for field in kind.fields:
            own, below = _field(held, field.name), f"{field.name}."
            inner = frozenset(path.removeprefix(below) for path in required if path.startswith(below))
            typed = fits(own, field.dataType, inner)
            if field.name in required or inner:
                tests.append(typed)
            else:
                tests.append(own.isNull() | F.is_variant_null(own) | typed)
        return F.coalesce(reduce(lambda one, other: one & other, tests), F.lit(False))
    if isinstance(kind, T.ArrayType):
        every = F.forall(F.try_variant_get(held, "$", "array<variant>"), lambda item: fits(item, kind.elementType))
        return F.coalesce(written.startswith("ARRAY<") & every, F.lit(False))
    if isinstance(kind, T.IntegerType):
        return F.coalesce((written == "BIGINT") & F.try_variant_get(held, "$", "int").isNotNull(), F.lit(False))
    return F.coalesce(written == {"string": "STRING", "bigint": "BIGINT", "boolean": "BOOLEAN"}[kind.simpleString()], F.lit(False))


def _shape(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The part of a schema that a shape names."""
    names = {path.split(".")[0] for path in paths}
    return T.StructType([field for field in schema.fields if field.name in names])


def _first_shape(schema: T.StructType, shapes: dict[str, list[str]]) -> list[Column]:
    return [F.when(fits(F.col(JSON), _shape(schema, paths), frozenset(paths)), F.lit(kind)) for kind, paths in shapes.items()]


def inbound_fields(kind: str) -> Column:
    """The fields of an inbound shape, typed; for rows of that kind."""
    return F.try_variant_get(F.col(JSON), "$", _shape(_INBOUND, INBOUND_SHAPES[kind]).simpleString())


def route_inbound(parsed: DataFrame, value: str = "value") -> DataFrame:
    """Add ``kind``, the first shape that fits, to messages with ``json``."""
    words = [F.when(F.col(value) == F.lit(word), F.lit(kind)) for word, kind in INBOUND_WORDS.items()]
    return parsed.withColumn("kind", F.coalesce(*_first_shape(_INBOUND, INBOUND_SHAPES), *words, F.lit("unparsed")))


def route_outbound(parsed: DataFrame, me: str | None = None) -> DataFrame:
    """Add ``kinds``, every part a client would act on; a part of a wrong type is left out, the others stay."""
    types = {field.name: field.dataType for field in _OUTBOUND.fields}

    def has(name: str) -> Column:
        return fits(_field(F.col(JSON), name), types[name])

    def text(path: str) -> Column:
        return F.try_variant_get(F.col(JSON), f"$.{path}", "string")

    typing = has("wrt")
    if me is not None:
        typing = typing & ~text("wrt.writerId").eqNullSafe(F.col(me))
    number = F.try_variant_get(F.col(JSON), "$.num", "bigint")
    tests = {
        "new_messages": has("newMsgList"),
        "old_messages": has("oldMsgList"),
        "invitation": has("inv"),
        "writing": typing,
        "opened": has("comm") & (text("comm") == "opened correctly"),
        "error": has("num") & has("message") & (number != 0) & (F.length(text("message")) > 0),
    }
    return parsed.withColumn("kinds", F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()])))


def decode_commands(parsed: DataFrame) -> DataFrame:
    """Add ``command``; a list of users that are not all UUIDs is ``unparsed``."""
    users = F.try_variant_get(F.col(JSON), "$.users", "array<string>")
    ids_hold = F.coalesce(F.forall(users, lambda user: F.coalesce(user.rlike(rf"\A{UUID_TEXT}\z"), F.lit(False))), F.lit(True))
    command = F.coalesce(*_first_shape(_COMMAND, COMMAND_SHAPES), F.lit("unparsed"))
    return parsed.withColumn("command", F.when(ids_hold, command).otherwise(F.lit("unparsed")))
