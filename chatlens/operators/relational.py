"""Reports over users, chats, memberships and sessions, each for everybody at once.

Results that the chat system nests per user or per chat stay flat here, one row per
(user, chat) or (chat, member), or come in pages of bounded length: a list of all members
of the largest chat would have to be built by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import offsets_array, session_expiry
from chatlens.plans import numbered

OFFSET_COLUMNS = ("users_offset_0", "users_offset_1", "users_offset_2")


# --- sessions -------------------------------------------------------------------------


def active_sessions(sessions: DataFrame, now_ms: int) -> DataFrame:
    return sessions.filter(F.col("validity_time") > F.lit(now_ms))


def purge_expired_sessions(sessions: DataFrame, cutoff: int | DataFrame) -> DataFrame:
    """The sessions that stay. ``cutoff`` is one time or a (user_id, cutoff) table."""
    if isinstance(cutoff, int):
        return sessions.filter(F.col("validity_time") >= F.lit(cutoff))
    return (
        sessions.join(cutoff.select("user_id", "cutoff"), "user_id", "left")
        .filter(F.col("cutoff").isNull() | (F.col("validity_time") >= F.col("cutoff")))
        .drop("cutoff")
    )


def user_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """All sessions of the given users."""
    return sessions.join(users.select("user_id"), "user_id", "left_semi")


def valid_session_count(sessions: DataFrame, now_ms: int) -> DataFrame:
    return active_sessions(sessions, now_ms).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


def session_expiries(users: DataFrame, settings: DataFrame, now_ms: int) -> DataFrame:
    """When a session opened now would end, per user."""
    return users.select("user_id").join(settings, "user_id").select(
        "user_id", session_expiry(F.lit(now_ms), "session_duration").alias("validity_time")
    )


# --- looking users up -----------------------------------------------------------------


def _hit(pattern: str) -> Column:
    return F.col("login").rlike(f"(?i){pattern}")


def search_users(users: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Users whose login matches, per pattern; case does not matter.

    All patterns are tested in one pass over the users.
    """
    hits = F.array_compact(F.array(*[F.when(_hit(pattern), F.lit(pattern)) for pattern in patterns]))
    any_hit = reduce(lambda left, right: left | right, [_hit(pattern) for pattern in patterns])
    return users.filter(any_hit).select(F.explode(hits).alias("pattern"), "user_id", "login")


def user_by_login(users: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("login").distinct().join(users, "login").select("user_id", "login")


def missing_users(users: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("user_id", "login")) -> DataFrame:
    """The wanted users that do not exist under exactly these keys."""
    return wanted.join(users.select(*keys), list(keys), "left_anti")


def invite_candidates(
    hits: DataFrame, requests: DataFrame, selected: DataFrame, members: DataFrame
) -> DataFrame:
    """Search hits a user may still invite, per request.

    ``hits`` (request_id, user_id, login) come from a search; ``requests`` (request_id, me,
    chat_id) name who asks for which chat; ``selected`` (request_id, user_id) are picked
    already; ``members`` (chat_id, login) are in the chat.
    """
    asked = hits.join(requests, "request_id").filter(~F.col("user_id").eqNullSafe(F.col("me")))
    unpicked = asked.join(selected.select("request_id", "user_id"), ["request_id", "user_id"], "left_anti")
    return unpicked.join(members.select("chat_id", "login"), ["chat_id", "login"], "left_anti").select(
        "request_id", "chat_id", "user_id", "login"
    )


# --- profiles and chats ---------------------------------------------------------------


def chat_data(users_chats: DataFrame, chats: DataFrame, offset_columns: Sequence[str] = OFFSET_COLUMNS) -> DataFrame:
    """Each membership with its chat's data and read offsets."""
    return users_chats.join(chats, "chat_id").select(
        "user_id",
        "chat_id",
        "chat_name",
        "group_chat",
        "message_time",
        "silent",
        offsets_array(offset_columns).alias("partition_offsets"),
    )


def user_profile_chats(
    users: DataFrame,
    settings: DataFrame,
    users_chats: DataFrame,
    chats: DataFrame,
    offset_columns: Sequence[str] = OFFSET_COLUMNS,
) -> DataFrame:
    """One row per (user, chat) with the user's settings."""
    known = users.select("user_id", "login").join(
        settings.select("user_id", "joining_offset", "session_duration", "zone_id"), "user_id"
    )
    return chat_data(users_chats, chats, offset_columns).join(known, "user_id")


def user_profile(users: DataFrame, settings: DataFrame, users_chats: DataFrame, chats: DataFrame) -> DataFrame:
    """As above, but users without chats keep one row, with a null chat."""
    known = users.select("user_id", "login").join(
        settings.select("user_id", "joining_offset", "session_duration", "zone_id"), "user_id"
    )
    return known.join(chat_data(users_chats, chats), "user_id", "left")


def my_chats(users_chats: DataFrame, chats: DataFrame) -> DataFrame:
    """Each user's chats, once each. Memberships are unique per (chat, user)."""
    return chat_data(users_chats, chats)


def chat_members(users_chats: DataFrame, users: DataFrame) -> DataFrame:
    return users_chats.select("chat_id", "user_id").join(users.select("user_id", "login"), "user_id").select(
        "chat_id", "user_id", "login"
    )


def chats_with_members(
    users_chats: DataFrame, chats: DataFrame, users: DataFrame, members_per_page: int = 1000, pieces: int | None = None
) -> DataFrame:
    """Every chat with its members, in pages of at most ``members_per_page``.

    A chat's members do not depend on who asks, so they are listed once per chat; a user's
    view is ``my_chats`` joined to this on ``chat_id``.
    """
    members = chat_members(users_chats, users).join(chats.select("chat_id", "group_chat"), "chat_id")
    placed = numbered(members, ["chat_id"], ["user_id"], "_position", pieces)
    page = F.floor((F.col("_position") - 1) / F.lit(members_per_page)).cast("int")
    return (
        placed.groupBy("chat_id", "group_chat", page.alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("user_id", "login"))).alias("members"))
    )


def chat_member_count(users_chats: DataFrame) -> DataFrame:
    return users_chats.groupBy("chat_id").agg(F.count(F.lit(1)).alias("members"))


def chats_per_user(users_chats: DataFrame) -> DataFrame:
    return users_chats.groupBy("user_id").agg(F.count(F.lit(1)).alias("chats"))


# --- direct chats ---------------------------------------------------------------------


def _direct_pair(chat_id: str) -> list[Column]:
    parts = F.split(chat_id, "--")
    first, second = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return [F.least(first, second).alias("first_user"), F.greatest(first, second).alias("second_user")]


def duplicate_direct_chats(direct_chats: DataFrame) -> DataFrame:
    """Pairs of users with more than one direct chat, in whichever order the id names them."""
    return (
        direct_chats.select("chat_id", *_direct_pair("chat_id"))
        .groupBy("first_user", "second_user")
        .agg(F.count(F.lit(1)).alias("chats"), F.min("chat_id").alias("kept_chat"))
        .filter("chats > 1")
    )


def existing_direct_chats(wanted: DataFrame, direct_chats: DataFrame) -> DataFrame:
    """The wanted direct chats (chat_id) that exist already, under either id order."""
    pairs = direct_chats.select(*_direct_pair("chat_id")).distinct()
    return wanted.select("*", *_direct_pair("chat_id")).join(
        pairs, ["first_user", "second_user"], "left_semi"
    ).select(*wanted.columns)


# --- nested output --------------------------------------------------------------------


def _chat_entry() -> Column:
    return F.struct(
        F.struct(
            F.col("chat_id").alias("chatId"),
            F.col("chat_name").alias("chatName"),
            F.col("group_chat").alias("groupChat"),
            F.col("message_time").alias("lastMessageTime"),
            F.col("silent").alias("silent"),
        ).alias("chat"),
        F.col("partition_offsets").alias("partitionOffsets"),
    )


def encode_chats(chat_rows: DataFrame) -> DataFrame:
    """One JSON object per (user, chat)."""
    return chat_rows.select("user_id", "chat_id", F.to_json(_chat_entry()).alias("json"))


def encode_profile(profile: DataFrame, chats_per_page: int = 100, pieces: int | None = None) -> DataFrame:
    """A user's settings and chats as JSON, in pages of at most ``chats_per_page`` chats.

    Takes the rows of ``user_profile``. Most users fit on page 0; a user without chats has
    one page with an empty list.
    """
    placed = numbered(profile, ["user_id"], ["chat_id"], "_position", pieces)
    page = F.floor((F.col("_position") - 1) / F.lit(chats_per_page)).cast("int")
    header = ["user_id", "login", "joining_offset", "session_duration", "zone_id"]
    entry = F.when(F.col("chat_id").isNotNull(), _chat_entry())
    return (
        placed.groupBy(*header, page.alias("page"))
        .agg(F.sort_array(F.collect_list(entry)).alias("chat_list"))
        .select(
            "user_id",
            "page",
            F.to_json(
                F.struct(
                    F.struct(F.col("user_id").alias("userId"), F.col("login")).alias("user"),
                    F.struct(
                        F.col("joining_offset").alias("joiningOffset"),
                        F.col("session_duration").alias("sessionDuration"),
                        F.col("zone_id").alias("zoneId"),
                    ).alias("settings"),
                    F.col("chat_list").alias("chatList"),
                )
            ).alias("json"),
        )
    )
