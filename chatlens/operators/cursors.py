"""Read positions in the chat log, for all users at once.

A *cursor* row says where a user stands in one partition of a chat: (user_id, chat_id,
partition, offset), ``offset`` being the next record to read. The *log* has one row per
record: (chat_id, partition, offset, server_time, ...).

Counts and latest times of unread records never pair users with records: a cursor meets the
directory of its chat, in which it reads the entries of one cell and the totals of all after it.
Only ``unread_messages``, whose result is the pairs themselves, joins the two.

Where a function takes a log, a ``LaidOutLog`` does as well; its records are then not shuffled.

Exploded positions look as small to the optimizer as the table they come from, so joins with
them ask for a sort-merge join instead of a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions import offset_sum
from chatlens.plans import materialize, met, numbered, scratch_path
from chatlens.sources.cells import Directory, cells_of, sizes
from chatlens.sources.layout import CELL, LaidOutLog

PAGE_SIZE = 15  # fixed value: records of history per partition and page
OFFSETS_PER_BLOCK = 65_536

_RECORD = ["chat_id", "partition", "offset"]


def cursors(users_chats: DataFrame, offset_columns: Sequence[str], *keep: str) -> DataFrame:
    """Wide offset columns as one cursor row per partition; ``keep`` names columns to carry along."""
    offsets = F.array(*[F.col(name).cast("long") for name in offset_columns])
    return users_chats.select("user_id", "chat_id", *keep, F.posexplode(offsets).alias("partition", "offset"))


def read_count(users_chats: DataFrame, offset_columns: Sequence[str]) -> DataFrame:
    """Records read per (user, chat): the sum of its offsets."""
    total = sum((F.col(name) for name in offset_columns[1:]), F.col(offset_columns[0]))
    return users_chats.select("user_id", "chat_id", total.cast("long").alias("read"))


# --- unread ---------------------------------------------------------------------------


def _block(offset: Column | str = "offset", per_block: int | None = None) -> Column:
    return F.floor((F.col(offset) if isinstance(offset, str) else offset) / F.lit(per_block or OFFSETS_PER_BLOCK))


def _in_blocks(log: DataFrame | LaidOutLog, per_block: int) -> tuple[DataFrame, list[str], int]:
    """Records with their ``_block``, the log's own columns, and the offsets in a block."""
    if isinstance(log, LaidOutLog):
        return log.in_cells.withColumnRenamed(CELL, "_block"), log.records.columns, log.per_cell
    return log.withColumn("_block", _block("offset", per_block)), log.columns, per_block


def _ends(log: DataFrame | LaidOutLog) -> DataFrame:
    if isinstance(log, LaidOutLog):
        return log.ends()
    return log.groupBy("chat_id", "partition").agg(F.max("offset").alias("last_offset"))


def unread_ranges(
    log: DataFrame | LaidOutLog, positions: DataFrame, per_block: int | None = None, offset_columns: Sequence[str] | None = None
) -> DataFrame:
    """Per cursor, with all its columns, the unread part of its partition: count, last offset
    and latest time.

    ``[offset, last_offset]`` is the range a reader has to fetch; it is empty (nulls and a
    zero count) for a reader who is up to date. Partitions are gathered in blocks of about ``per_block``
    offsets. ``positions`` may be memberships with one of ``offset_columns`` per partition: they move as such
    and come out as cursors.
    """
    if isinstance(log, LaidOutLog):
        return log.unread_ranges(positions, offset_columns)
    per_cell, cells = sizes(per_block or OFFSETS_PER_BLOCK)
    directory = Directory(cells_of(log, per_cell, cells), per_cell, cells)
    found = directory.meet(positions, offset_columns).withColumn("_ahead", directory.ahead())
    others = [name for name in positions.columns if name not in [*_RECORD, *(offset_columns or [])]]
    return found.select(
        *_RECORD, *others, F.col("_ahead.n").alias("unread"), F.col("_ahead.last").alias("last_offset"), F.col("_ahead.newest").alias("newest_ms")
    )


def unread_count(log: DataFrame | LaidOutLog, positions: DataFrame, per_block: int | None = None) -> DataFrame:
    """Unread records per (user, chat), with the time of the newest one."""
    return (
        unread_ranges(log, positions, per_block)
        .groupBy("user_id", "chat_id")
        .agg(F.sum("unread").alias("unread"), F.max("newest_ms").alias("newest_ms"))
    )


def unread_messages(log: DataFrame | LaidOutLog, positions: DataFrame) -> DataFrame:
    """The unread records of every reader, one row per (user, record).

    Reader and record meet in a block of offsets, so a busy chat is split over many tasks
    and a reader touches only blocks with something left to read.
    """
    records, columns, size = _in_blocks(log, OFFSETS_PER_BLOCK)
    blocks = F.sequence(_block("_from", size), _block("last_offset", size))
    readers = (
        met(positions.select("user_id", "chat_id", "partition", F.col("offset").alias("_from")), _ends(log), ["chat_id", "partition"])
        .filter(F.col("_from") <= F.col("last_offset"))
        .select("user_id", "chat_id", "partition", "_from", F.explode(blocks).alias("_block"))
    )
    # Records of a laid-out log lie by their cells and are not dealt again, as they would be by a digest.
    keys = ["chat_id", "partition", "_block"]
    # Written before they meet the records: what led to them, mostly readers who are up to date, leaves the disk.
    readers = materialize(readers, scratch_path(positions.sparkSession, "readers"))
    pairs = records.join(readers.hint("merge"), keys) if isinstance(log, LaidOutLog) else met(records, readers, keys)
    return (
        pairs.filter(F.col("offset") >= F.col("_from"))
        .select("user_id", *columns)
    )


def unread_in_time_order(log: DataFrame | LaidOutLog, positions: DataFrame) -> DataFrame:
    return unread_messages(log, positions).orderBy("user_id", "server_time", *_RECORD)


def records_since(log: DataFrame | LaidOutLog, positions: DataFrame) -> DataFrame:
    """The records that somebody has still to read, once each: those at or after the smallest position of their partition.

    This is what a reader fetches that starts from the stored positions. Of a laid-out log, cells before them
    are told by the summary, and nothing of the log is shuffled.
    """
    starts = positions.groupBy("chat_id", "partition").agg(F.min("offset").alias("_from"))
    if isinstance(log, LaidOutLog):
        wanted = log.cells.select("chat_id", "partition", CELL).distinct().join(starts, ["chat_id", "partition"])
        wanted = wanted.filter(F.col(CELL) >= _block("_from", log.per_cell))
        found = log.in_cells.join(wanted.hint("merge"), ["chat_id", "partition", CELL])
        return found.filter(F.col("offset") >= F.col("_from")).select(*log.records.columns)
    return met(log, starts, ["chat_id", "partition"]).filter(F.col("offset") >= F.col("_from")).select(*log.columns)


# --- history --------------------------------------------------------------------------


def history_page(log: DataFrame | LaidOutLog, positions: DataFrame, page: int = 0, page_size: int = PAGE_SIZE) -> DataFrame:
    """The records just before each reader's position; page 1 are those before page 0.

    Per partition a page spans ``page_size`` offsets. A chat whose positions are all zero has
    no history left.
    """
    # Readers at one position share a page, which lies in few blocks, in two of its length at most.
    records, columns, size = _in_blocks(log, page_size)
    places = positions.select(*_RECORD).distinct()
    before = F.greatest(F.col("offset") - F.lit(page * page_size), F.lit(0))
    spans = places.select(
        *_RECORD, F.greatest(before - F.lit(page_size), F.lit(0)).alias("_from"), before.alias("_to")
    ).filter(F.col("_to") > 0)
    blocks = F.sequence(_block("_from", size), _block(F.col("_to") - 1, size))
    spans = spans.select(
        "chat_id", "partition", F.col("offset").alias("_place"), "_from", "_to", F.explode(blocks).alias("_block")
    )
    pages = (
        spans.hint("merge")
        .join(records, ["chat_id", "partition", "_block"])
        .filter((F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_to")))
    )
    readers = positions.select("user_id", "chat_id", "partition", F.col("offset").alias("_place"))
    return pages.join(readers, ["chat_id", "partition", "_place"]).select("user_id", *columns)


# --- moving positions -----------------------------------------------------------------


def next_offsets(log: DataFrame | LaidOutLog, positions: DataFrame) -> DataFrame:
    """Cursors after reading everything in ``log``; none moves backwards."""
    seen = _ends(log).select("chat_id", "partition", (F.col("last_offset") + 1).alias("_next"))
    return positions.join(seen, ["chat_id", "partition"], "left").select(
        "user_id", "chat_id", "partition", F.greatest("offset", "_next").alias("offset")
    )


def apply_offset_updates(
    users_chats: DataFrame, updates: DataFrame, offset_columns: Sequence[str], accepted_sum: str | None = None
) -> DataFrame:
    """Memberships after a series of client updates.

    ``updates``: (user_id, chat_id, last_message_time, partition_offsets, arrival). An update
    counts only if its offset sum exceeds that of everything accepted before, so of a series
    the first one with the largest sum remains. What is stored is each offset plus one.
    Updates for unknown chats have no effect.

    ``accepted_sum`` names a column of the memberships that holds the sum of the last accepted update, null before
    the first; with it a series may come in several parts.
    """
    # One number orders the updates, largest sum and then earliest arrival first, so the aggregate
    # keeps numbers only. A partition named twice counts with its larger offset, one without a number not at all.
    def offset_of(partition: int) -> Column:
        named = F.filter("partition_offsets", lambda item: item["partition"] == partition)
        return F.array_max(F.transform(named, lambda item: item["offset"]))

    total = offset_sum("partition_offsets")
    step = F.lit("10000000000000000000").cast("decimal(20,0)")  # above every arrival
    key = (total.cast("decimal(19,0)") * step - F.col("arrival").cast("decimal(19,0)")).cast("decimal(38,0)")
    ranked = updates.select(
        "user_id", "chat_id", "last_message_time", total.alias("_total"), key.alias("_key"),
        *[offset_of(partition).cast("long").alias(f"_new_{name}") for partition, name in enumerate(offset_columns)],
    )
    best = ranked.groupBy("user_id", "chat_id").agg(
        F.max("_total").alias("_total"),
        F.max_by("last_message_time", "_key").alias("_time"),
        *[F.max_by(f"_new_{name}", "_key").alias(f"_new_{name}") for name in offset_columns],
    )
    stored = sum((F.col(name) for name in offset_columns[1:]), F.col(offset_columns[0]))
    accepted = F.col("_total") > (F.coalesce(accepted_sum, stored) if accepted_sum else stored)
    changed = {
        name: F.when(accepted, F.coalesce(F.col(f"_new_{name}") + 1, F.col(name))).otherwise(F.col(name))
        for name in offset_columns
    }
    changed["message_time"] = F.when(accepted, F.col("_time")).otherwise(F.col("message_time"))
    if accepted_sum:
        changed[accepted_sum] = F.when(accepted, F.col("_total").cast("long")).otherwise(F.col(accepted_sum))
    joined = users_chats.join(best, ["user_id", "chat_id"], "left")
    return joined.select(*[changed[name].alias(name) if name in changed else F.col(name) for name in users_chats.columns])


def mark_read(log: DataFrame | LaidOutLog, users_chats: DataFrame, offset_columns: Sequence[str], per_block: int | None = None) -> DataFrame:
    """Fold the unread records into what is read: per partition the last offset seen, and per
    (user, chat) the latest time, both only ever growing."""
    members = users_chats.select("user_id", "chat_id", "message_time", *offset_columns)
    ranges = unread_ranges(log, members, per_block, offset_columns)
    last = F.greatest("offset", "last_offset")
    return ranges.groupBy("user_id", "chat_id").agg(
        F.greatest(F.max("message_time"), F.max("newest_ms")).alias("message_time"),
        *[
            F.max(F.when(F.col("partition") == partition, last)).alias(name)
            for partition, name in enumerate(offset_columns)
        ],
    )


# --- invitations ----------------------------------------------------------------------


def invitation_backlog(invitations: DataFrame, settings: DataFrame) -> DataFrame:
    """Invitations at or after a user's joining offset, each with the offset to continue at."""
    return (
        invitations.join(settings.select("user_id", "joining_offset"), "user_id")
        .filter(F.col("offset") >= F.col("joining_offset"))
        .select(*invitations.columns, (F.col("offset") + 1).alias("my_joining_offset"))
    )


def next_joining_offsets(invitations: DataFrame, settings: DataFrame) -> DataFrame:
    seen = invitations.groupBy("user_id").agg((F.max("offset") + 1).alias("_next"))
    return settings.join(seen, "user_id", "left").select(
        "user_id", F.greatest("joining_offset", "_next").alias("joining_offset")
    )


def new_chats_from_invitations(
    invitations: DataFrame, users_chats: DataFrame, offset_columns: Sequence[str]
) -> DataFrame:
    """Chats a user was invited to and does not have; the first invitation gives the name."""
    # The first invitation of each (user, chat) is found before the chats the user has are taken away: one key
    # serves both, and a task passes on one row of it, however often a user was invited.
    order = Window.partitionBy("user_id", "chat_id").orderBy("offset", "login", "chat_name")
    first = invitations.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return first.join(users_chats.select("user_id", "chat_id"), ["user_id", "chat_id"], "left_anti").select(
        "user_id",
        "chat_id",
        "chat_name",
        F.col("login").alias("invited_by"),
        *[F.lit(0).cast("long").alias(name) for name in offset_columns],
    )


# --- who is typing --------------------------------------------------------------------


def typing_now(writing: DataFrame, lifetime: str = "1 second", me: str | None = None, watermark: str | None = None) -> DataFrame:
    """Who is typing in which chat, per slot of ``lifetime``; ``me`` is left out if given.

    One row per writer, so a crowded chat needs no list of all its writers in one task.
    """
    if me is not None:
        writing = writing.filter(F.col("writer_id") != F.lit(me))
    if watermark is not None and writing.isStreaming:
        writing = writing.withWatermark("server_time", watermark)
    slot = F.window("server_time", lifetime)
    return (
        writing.groupBy(slot, "chat_id", "writer_id")
        .agg(F.min("writer_login").alias("writer_login"))
        .select(F.col("window.start").alias("slot_start"), "chat_id", "writer_id", "writer_login")
    )


def typing_intervals(
    writing: DataFrame, lifetime: str = "1 second", me: str | None = None, watermark: str | None = None
) -> DataFrame:
    """From when until when each writer was typing in a chat: (chat_id, writer_id, writer_login, typing_from, typing_until, signals).

    A signal lasts for ``lifetime``; one that comes while, or just as, the one before it ends goes on with the interval.
    An interval so ends a lifetime after its last signal. On a stream it appears once the watermark has passed its
    end; without ``watermark`` it appears in update mode only.
    """
    if me is not None:
        writing = writing.filter(F.col("writer_id") != F.lit(me))
    if watermark is not None and writing.isStreaming:
        writing = writing.withWatermark("server_time", watermark)
    return (
        writing.groupBy(F.session_window("server_time", lifetime).alias("_typing"), "chat_id", "writer_id")
        .agg(F.min("writer_login").alias("writer_login"), F.count(F.lit(1)).alias("signals"))
        .select(
            "chat_id",
            "writer_id",
            "writer_login",
            F.col("_typing.start").alias("typing_from"),
            F.col("_typing.end").alias("typing_until"),
            "signals",
        )
    )


# --- orders ---------------------------------------------------------------------------


def chat_list_order(
    log: DataFrame | LaidOutLog,
    users_chats: DataFrame,
    offset_columns: Sequence[str],
    per_block: int | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Each user's chats, newest first: by the latest unread record, else by the last one read."""
    members = users_chats.select("user_id", "chat_id", "message_time", *offset_columns)
    ranges = unread_ranges(log, members, per_block, offset_columns)
    keyed = ranges.groupBy("user_id", "chat_id").agg(
        F.coalesce(F.max("newest_ms"), F.max("message_time")).alias("sort_time")
    )
    # Written before it is put in order: the ranges are found by a first look at it, and what led to it leaves the disk.
    keyed = materialize(keyed, scratch_path(users_chats.sparkSession, "keyed"))
    return numbered(keyed, ["user_id"], [F.desc("sort_time"), F.col("chat_id")], "position", pieces)


def chats_by_last_message(users_chats: DataFrame, newest_first: bool = False) -> DataFrame:
    """Memberships per user in order of their last message."""
    order = F.col("message_time").desc() if newest_first else F.col("message_time").asc()
    return users_chats.orderBy("user_id", order, "chat_id")


def timeline(messages: DataFrame) -> DataFrame:
    """Records per chat in order of receipt; partition and offset decide between equal times."""
    return messages.orderBy("chat_id", "server_time", "partition", "offset")


def merge_old_new(loaded: DataFrame, older: DataFrame) -> DataFrame:
    """Loaded records with an older page added; a record present in both appears once."""
    return loaded.unionByName(older.select(*loaded.columns)).dropDuplicates(_RECORD)


def merge_old_new_stream(loaded: DataFrame, older: DataFrame, watermark: str) -> DataFrame:
    """The same on streams: a record that comes again within ``watermark`` of event time appears once.

    The state forgets a record once the watermark has passed it, so it is bounded however long the streams run.
    """
    both = loaded.unionByName(older.select(*loaded.columns))
    return both.withWatermark("server_time", watermark).dropDuplicatesWithinWatermark(_RECORD)
