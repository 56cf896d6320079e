"""Column functions. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns; they decide which names the chat system accepts.
CHAT_TOPIC = r"chat--([\p{Alnum}-]*)"
CHAT_NAME = r"[\w]+[\s\w]*"
INVALID_LOGIN = r"([\p{Alnum}\p{Punct}]*[\p{Punct}]+[\p{Alnum}\p{Punct}]*)|([0-9]+)"
UUID_TEXT = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
WHOLE_NUMBER = r"[+-]?[0-9]+"

# Everything up to and including the space counts as margin when a message is trimmed.
_MARGIN = "".join(chr(code) for code in range(0x21))


# Ids of time zones, without the few entries of the zone database that are no zones.
KNOWN_ZONES = sorted(name for name in available_timezones() if "/" in name or name in {"UTC", "GMT"})


def _full_match(column: Column | str, pattern: str) -> Column:
    return F.col(column).rlike(rf"\A(?:{pattern})\z") if isinstance(column, str) else column.rlike(
        rf"\A(?:{pattern})\z"
    )


def is_chat_topic(topic: Column | str) -> Column:
    return _full_match(topic, CHAT_TOPIC)


def is_valid_chat_name(name: Column | str) -> Column:
    return _full_match(name, CHAT_NAME)


def is_invalid_login(login: Column | str) -> Column:
    return _full_match(login, INVALID_LOGIN)


def count_words(content: Column | str) -> Column:
    """Pieces between single whitespace characters of the trimmed text.

    Two spaces in a row enclose an empty piece, which counts; empty text is one piece, null stays null.
    """
    trimmed = F.btrim(content, F.lit(_MARGIN))
    return F.regexp_count(trimmed, F.lit(r"\s")) + 1


def delivery_delay_ms(server_time: Column | str = "server_time", message_time: Column | str = "message_time") -> Column:
    """Milliseconds from sending to receipt; negative where clocks disagree."""
    return F.unix_millis(server_time) - F.unix_millis(message_time)


def average_text(total: Column | str, count: Column | str) -> Column:
    """``total / count`` with two decimals, ties to even; an empty count divides by one."""
    total = F.col(total) if isinstance(total, str) else total
    count = F.col(count) if isinstance(count, str) else count
    quotient = F.coalesce(total, F.lit(0)).cast("decimal(20,0)") / F.greatest(count, F.lit(1)).cast("decimal(20,0)")
    return F.bround(quotient, 2).cast("decimal(20,2)").cast("string")


def rounded_ms(average: Column | str) -> Column:
    """A fractional delay as whole milliseconds, ties away from zero."""
    return F.round(average, 0).cast("long")


def instant_text(ts: Column | str) -> Column:
    """A UTC instant on a whole second, such as ``2024-01-01T00:00:00Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def known_zone(zone_id: Column | str) -> Column:
    """The zone id, or null where it names no zone; one wrong id must not fail a job."""
    zone = F.col(zone_id) if isinstance(zone_id, str) else zone_id
    return F.when(zone.isin(*KNOWN_ZONES), zone)


def local_time_text(epoch_ms: Column | str, zone_id: Column | str) -> Column:
    """Epoch milliseconds shown on the clock of ``zone_id``, with the offset the zone has at that time.

    Null for an unknown zone. The offset stands for the zone's short name, which differs by locale.
    """
    utc = F.timestamp_millis(epoch_ms)
    local = F.from_utc_timestamp(utc, known_zone(zone_id))
    minutes = F.floor((F.unix_millis(local) - F.unix_millis(utc)) / 60_000)
    hours = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    rest = F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")
    sign = F.when(minutes < 0, F.lit(" GMT-")).otherwise(F.lit(" GMT+"))
    return F.concat(F.date_format(local, "EEEE, dd/MM/yyyy, HH:mm:ss"), sign, hours, F.lit(":"), rest)


def offsets_array(columns: Sequence[str]) -> Column:
    """Wide columns, one per partition, as an array of (partition, offset)."""
    return F.array(
        *[
            F.struct(F.lit(partition).alias("partition"), F.col(name).cast("long").alias("offset"))
            for partition, name in enumerate(columns)
        ]
    )


def offset_sum(offsets: Column | str) -> Column:
    """Sum of the offsets in an array of (partition, offset)."""
    return F.aggregate(offsets, F.lit(0).cast("long"), lambda acc, item: acc + item["offset"])


def session_expiry(now_ms: Column | str, duration_ms: Column | str) -> Column:
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    duration = F.col(duration_ms) if isinstance(duration_ms, str) else duration_ms
    return now + duration


def session_token(token: Column | str) -> Column:
    """``session__user__millis`` as a struct, or null unless all three parts are well formed."""
    token = F.col(token) if isinstance(token, str) else token
    # Empty parts at the end do not count as parts.
    parts = F.split(F.regexp_replace(token, r"(?:__)+\z", ""), "__")
    well_formed = (
        (F.size(parts) == 3)
        & _full_match(F.get(parts, F.lit(0)), UUID_TEXT)
        & _full_match(F.get(parts, F.lit(1)), UUID_TEXT)
        & _full_match(F.get(parts, F.lit(2)), WHOLE_NUMBER)
    )
    validity = F.get(parts, F.lit(2)).try_cast("long")
    return F.when(
        well_formed & validity.isNotNull(),
        F.struct(
            F.lower(F.get(parts, F.lit(0))).alias("session_id"),
            F.lower(F.get(parts, F.lit(1))).alias("user_id"),
            validity.alias("validity_time"),
        ),
    )
