"""Every operator as a query over the sample tables: name -> (session, folder) -> frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import functions as fn
from chatlens.operators import cursors as cur
from chatlens.operators import encode, graph, relational, routing, search, variants, windows
from chatlens.plans import discard, materialize, scratch_path
from chatlens.session import prepare
from chatlens.sources import fixtures as fx
from chatlens.sources import layout, log
from chatlens.sources.ranks import RankTable
from chatlens.sources.sessions import SessionDays
from chatlens.streaming import (
    VersionedTable,
    latest_rows,
    run_available,
    to_compacted,
    to_csv,
    to_keyed,
    to_kept_and_late,
    to_table,
    to_versions,
)

Query = Callable[[SparkSession, str], DataFrame]

LOGIN_PATTERNS = ["supplier#0+1", "[1-3]0$", "99"]
_QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    """Register under the function's name; timestamps leave as zone-less UTC values."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = make(prepare(spark), sf)
        return df.select(
            *[
                F.col(field.name).cast("timestamp_ntz").alias(field.name)
                if isinstance(field.dataType, T.TimestampType)
                else F.col(field.name)
                for field in df.schema.fields
            ]
        )

    run.__name__ = make.__name__
    _QUERIES[make.__name__] = run
    return make


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable numbers as text; engines differ in how they hand out nulls among numbers."""
    return df.select(*[F.col(name).cast("string").alias(name) if name in columns else F.col(name) for name in df.columns])


# --- sources and sinks ----------------------------------------------------------------


@query
def src_chat_log(spark, sf):
    return log.chat_records(fx.envelopes(spark, sf)).select("topic", "partition", "offset", "timestamp")


@query
def decode_message(spark, sf):
    return log.decode_messages(fx.envelopes(spark, sf))


@query
def enrich_from_envelope(spark, sf):
    return log.enrich_from_envelope(fx.envelopes(spark, sf)).select(
        "chatId", "authorId", "serverTime", F.col("partOff.partition").alias("part"), F.col("partOff.offset").alias("off")
    )


@query
def src_tables(spark, sf):
    return fx.users(spark, sf)


@query
def sink_log(spark, sf):
    return encode.log_record(windows.num_messages(fx.delay_messages(spark, sf))).select(
        F.col("value").cast("string").alias("value")
    )


def _event_stream(spark, sf):
    """The sample messages as a stream; the aggregates keep only the columns they need."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(
        F.col("ts").cast("timestamp").alias("server_time"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - F.floor("value") * 1000).alias("message_time"),
        F.col("user_id").cast("string").alias("user_id"),
        fx.by_value(F.col("event_type"), fx.ZONES).alias("zone_id"),
        F.col("props").alias("content"),
    )


@query
def sink_table(spark, sf):
    """Streamed delay by user: windows appear once they are closed."""
    root = scratch_path(spark, "sink-table")
    result = windows.avg_delay_by_user(_event_stream(spark, sf))
    run_available(to_table(result, f"{root}/table"), "delay", root)
    return spark.read.parquet(f"{root}/table").select(*result.columns)


@query
def sink_csv(spark, sf):
    root = scratch_path(spark, "sink-csv")
    result = windows.avg_delay_by_zone(_event_stream(spark, sf))
    run_available(to_csv(result, f"{root}/csv"), "delay-by-zone", root)
    return spark.read.schema(result.schema).option("header", True).option("sep", "||").csv(f"{root}/csv")


@query
def stream_avg_words_updates(spark, sf):
    """Streamed words per message by zone: every change is kept, the last one counts."""
    root = scratch_path(spark, "updates")
    result = windows.split_window(windows.avg_words_windowed(_event_stream(spark, sf), "zone_id"))
    run_available(to_versions(result, f"{root}/table"), "words", root)
    return latest_rows(spark, f"{root}/table", result.schema, ["window_start", "window_end", "zone_id"])


@query
def stream_updates_compacted(spark, sf):
    """The same with versions folded into a snapshot after every batch."""
    root = scratch_path(spark, "compacted")
    result, keys = windows.split_window(windows.avg_words_windowed(_event_stream(spark, sf), "zone_id")), ["window_start", "window_end", "zone_id"]
    run_available(to_compacted(result, f"{root}/table", keys, compact_every=1), "words", root)
    return VersionedTable(spark, f"{root}/table", result.schema, keys).state()


def _in_thirds(df, arrival):
    """The rows in three parts of rising ``arrival``, as they would come one after another. They come straight from their
    table each time: a copy would take the disk of all of them once more."""
    low, high = df.agg(F.percentile_approx(arrival, [1 / 3, 2 / 3])).first()[0]
    return [df.filter(F.col(arrival) <= low), df.filter((F.col(arrival) > low) & (F.col(arrival) <= high)), df.filter(F.col(arrival) > high)]


@query
def late_records_streamed(spark, sf):
    """Late records of a live log that comes in three parts, by one stream time per chat."""
    root, server_us = scratch_path(spark, "grace"), F.unix_micros(F.col("server_time").cast("timestamp"))
    # A message of n milliseconds delay counts as sent n seconds before, so that some come late.
    delay_us = server_us - F.unix_micros(F.col("message_time").cast("timestamp"))
    messages = fx.delay_messages(spark, sf).select(
        "chat_id", "user_id", F.timestamp_micros(server_us - delay_us * 1000).alias("server_time"), "arrival"
    )
    for part in _in_thirds(messages, "arrival"):
        part.write.mode("append").parquet(f"{root}/log")
        log_stream = spark.readStream.schema(messages.schema).parquet(f"{root}/log")
        run_available(to_kept_and_late(log_stream, f"{root}/table", "arrival", ["chat_id"]), "grace", root)
    marked = spark.read.parquet(f"{root}/table").filter("late")
    return marked.select(*messages.columns, "stream_time_ms", "window_end_ms")


@query
def apply_offset_updates_streamed(spark, sf):
    """Updates that come in three parts, applied to the stored memberships."""
    root, keys = scratch_path(spark, "memberships"), ["user_id", "chat_id"]
    members = fx.users_chats(spark, sf).withColumn("accepted", F.lit(None).cast("long"))
    updates = fx.offset_updates(spark, sf)
    held = VersionedTable(spark, f"{root}/table", members.schema, keys)
    held.load(members)

    def merge(stored, changes):
        return cur.apply_offset_updates(stored, changes, fx.OFFSETS, "accepted")

    for part in _in_thirds(updates, "arrival"):
        part.write.mode("append").parquet(f"{root}/changes")
        changes = spark.readStream.schema(updates.schema).parquet(f"{root}/changes")
        run_available(to_keyed(changes, f"{root}/table", members.schema, keys, merge), "updates", root)
        discard(spark, f"{root}/changes")  # applied, so the stream does not come back to them
    return held.state().drop("accepted")


@query
def encode_delay(spark, sf):
    by_window = windows.split_window(
        windows.windowed(
            windows.with_delay(fx.delay_messages(spark, sf)),
            windows.DELAY_SIZE,
            {"avg_diff_time_ms": F.avg("diff_time_ms")},
            slide=windows.DELAY_SLIDE,
        )
    )
    return encode.encode_delay(by_window).select(F.col("value").cast("string").alias("value"))


@query
def encode_delay_by_user(spark, sf):
    delays = windows.avg_delay_by_user(fx.delay_messages(spark, sf))
    return encode.encode_delay(delays, "user_id").select(F.col("value").cast("string").alias("value"))


@query
def encode_delay_by_zone(spark, sf):
    delays = windows.avg_delay_by_zone(fx.delay_messages(spark, sf))
    return encode.encode_delay(delays, "zone_id").select(F.col("value").cast("string").alias("value"))


@query
def encode_keyed_result(spark, sf):
    return windows.keyed_result(
        windows.avg_words_windowed(fx.word_messages(spark, sf), "zone_id"), "zone_id", "avg_words"
    )


# --- projections and filters ----------------------------------------------------------


@query
def delivery_delay(spark, sf):
    return windows.with_delay(fx.delay_messages(spark, sf), "user_id")


@query
def split_window(spark, sf):
    return windows.split_window(
        windows.windowed(fx.document_messages(spark, sf), "60 seconds", {"messages": F.count(F.lit(1))}, ["zone_id"])
    )


@query
def split_window_text(spark, sf):
    return windows.split_window(
        windows.windowed(fx.document_messages(spark, sf), "60 seconds", {"messages": F.count(F.lit(1))}), text=True
    )


@query
def active_sessions(spark, sf):
    return relational.active_sessions(fx.sessions(spark, sf), fx.NOW_MS)


@query
def purge_expired_sessions(spark, sf):
    cutoffs = fx.users(spark, sf).select(
        "user_id", (F.lit(fx.NOW_MS) - F.col("user_num_id") * 3_600_000).alias("cutoff")
    )
    return relational.purge_expired_sessions(fx.sessions(spark, sf), cutoffs)


def _session_days(spark, sf):
    found = fx.sessions(spark, sf)
    held = SessionDays(spark, scratch_path(spark, "sessions"), found.schema)
    held.add(found)
    return held


@query
def purge_expired_sessions_by_day(spark, sf):
    """The same as a rewrite of sessions stored by day of expiry."""
    held = _session_days(spark, sf)
    held.purge(fx.users(spark, sf).select("user_id", (F.lit(fx.NOW_MS) - F.col("user_num_id") * 3_600_000).alias("cutoff")))
    return held.frame()


@query
def purge_all_sessions_by_day(spark, sf):
    """One time for all users: older days are dropped unread."""
    held = _session_days(spark, sf)
    held.purge(fx.NOW_MS + 10_000_000)
    return held.frame()


@query
def search_users(spark, sf):
    return relational.search_users(fx.users(spark, sf), LOGIN_PATTERNS)


@query
def search_users_indexed(spark, sf):
    """The patterns above, and the last four characters of every customer's name: thousands at once."""
    given = spark.createDataFrame([(pattern,) for pattern in LOGIN_PATTERNS], "pattern string")
    names = fx.table(spark, sf, "customer").select(F.concat(F.right("c_name", F.lit(4)), F.lit("$")).alias("pattern"))
    return search.search_users_indexed(fx.users(spark, sf), given.unionByName(names))


@query
def user_sessions(spark, sf):
    return relational.user_sessions(fx.sessions(spark, sf), fx.users(spark, sf))


@query
def topic_filter(spark, sf):
    return fx.envelopes(spark, sf).select("topic").distinct().select("topic", fn.is_chat_topic("topic").alias("is_chat"))


@query
def user_by_login(spark, sf):
    return relational.user_by_login(fx.users(spark, sf), fx.wanted_logins(spark, sf))


@query
def user_exists(spark, sf):
    return relational.missing_users(fx.users(spark, sf), fx.wanted_logins(spark, sf))


# --- joins ----------------------------------------------------------------------------


def _profile_columns(df):
    return df.select(
        "user_id",
        "login",
        "joining_offset",
        "session_duration",
        "zone_id",
        "chat_id",
        "chat_name",
        "group_chat",
        "message_time",
        "silent",
        *[F.col("partition_offsets")[part]["offset"].alias(name) for part, name in enumerate(fx.OFFSETS)],
    )


def _chat_columns(df):
    return df.select(
        "user_id",
        "chat_id",
        "chat_name",
        "group_chat",
        "message_time",
        "silent",
        *[F.col("partition_offsets")[part]["offset"].alias(name) for part, name in enumerate(fx.OFFSETS)],
    )


@query
def user_profile_chats(spark, sf):
    return _profile_columns(
        relational.user_profile_chats(
            fx.users(spark, sf), fx.settings(spark, sf), fx.users_chats(spark, sf), fx.chats(spark, sf)
        )
    )


@query
def user_profile(spark, sf):
    profile = _profile_columns(
        relational.user_profile(
            fx.profile_users(spark, sf), fx.profile_settings(spark, sf), fx.users_chats(spark, sf), fx.chats(spark, sf)
        )
    )
    return _as_text(profile, "group_chat", "message_time", "silent", *fx.OFFSETS)


@query
def chat_members(spark, sf):
    return relational.chat_members(fx.users_chats(spark, sf), fx.users(spark, sf))


@query
def chat_data(spark, sf):
    return _chat_columns(relational.chat_data(fx.users_chats(spark, sf), fx.chats(spark, sf)))


@query
def my_chats(spark, sf):
    return _chat_columns(relational.my_chats(fx.users_chats(spark, sf), fx.chats(spark, sf)))


@query
def chats_with_members(spark, sf):
    pages = relational.chats_with_members(
        fx.users_chats(spark, sf), fx.chats(spark, sf), fx.users(spark, sf), members_per_page=5
    )
    listed = F.transform("members", lambda member: F.concat_ws(":", member["user_id"], member["login"]))
    return pages.select("chat_id", "group_chat", "page", F.array_join(listed, ",").alias("members"))


@query
def chats_with_members_cut(spark, sf):
    """The same in 64 ranges."""
    pages = relational.chats_with_members(
        fx.users_chats(spark, sf), fx.chats(spark, sf), fx.users(spark, sf), members_per_page=5, pieces=64
    )
    listed = F.transform("members", lambda member: F.concat_ws(":", member["user_id"], member["login"]))
    return pages.select("chat_id", "group_chat", "page", F.array_join(listed, ",").alias("members"))


@query
def graph_membership(spark, sf):
    return graph.graph_membership(fx.users(spark, sf), fx.users_chats(spark, sf))


@query
def invite_candidates(spark, sf):
    """Every member of a chat looks for the user with the next number by login."""
    users, memberships = fx.users(spark, sf), fx.users_chats(spark, sf)
    request = F.concat_ws("/", "chat_id", "user_id")
    requests = memberships.select(request.alias("request_id"), F.col("user_id").alias("me"), "chat_id")
    number = F.lpad((F.col("me").cast("long") + 1).cast("string"), 9, "0")
    wanted = requests.select("request_id", F.concat(F.lit("Supplier#"), number).alias("login"))
    hits = wanted.join(users.select("user_id", "login"), "login").select("request_id", "user_id", "login")
    picked = fx.settings(spark, sf).filter("zone_id = 'UTC'").select("user_id")
    selected = hits.select("request_id", "user_id").join(picked, "user_id", "left_semi")
    members = relational.chat_members(memberships, users)
    return relational.invite_candidates(hits, requests, selected, members)


@query
def duplicate_direct_chat(spark, sf):
    return relational.duplicate_direct_chats(fx.direct_chats(spark, sf))


@query
def existing_direct_chat(spark, sf):
    swapped = F.concat(F.lit("chat--"), F.split_part("chat_id", F.lit("--"), F.lit(3)), F.lit("--"), F.split_part("chat_id", F.lit("--"), F.lit(2)))
    chats = fx.direct_chats(spark, sf)
    wanted = fx.users(spark, sf).select(
        F.concat(F.lit("chat--"), F.col("user_id"), F.lit("--"), (F.col("user_num_id") + 1_000_000).cast("string")).alias("chat_id")
    )
    return relational.existing_direct_chats(wanted.unionAll(wanted.select(swapped.alias("chat_id"))), chats)


@query
def triplets(spark, sf):
    edges = fx.shipment_edges(spark, sf)
    known = graph.default_vertices(edges, _graph_vertices(spark, sf), {"name": "John Doe"})
    return graph.triplets(edges, known, "name", "relation")


def _graph_vertices(spark, sf):
    return fx.users(spark, sf).select(F.col("user_num_id").alias("id"), F.col("login").alias("name"))


@query
def default_vertex(spark, sf):
    return graph.default_vertices(fx.shipment_edges(spark, sf), _graph_vertices(spark, sf), {"name": "John Doe"})


@query
def rank_join(spark, sf):
    """Two rank tables over different vertices: shipments per supplier, and per part."""
    lines = fx.table(spark, sf, "lineitem")
    ranks = [lines.groupBy(F.col(name).alias("id")).agg(F.count(F.lit(1)).cast("double").alias("rank")) for name in ("l_partkey", "l_suppkey")]
    return graph.rank_join(*ranks)


# --- aggregates -----------------------------------------------------------------------


@query
def avg_words_per_user(spark, sf):
    return windows.avg_words(fx.document_messages(spark, sf), "user_id")


@query
def avg_words_per_zone(spark, sf):
    return windows.avg_words(fx.document_messages(spark, sf), "zone_id")


@query
def average_num(spark, sf):
    sums = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_partkey").alias("total"), F.count_if(F.col("l_returnflag") == "A").alias("count")
    )
    return sums.select("l_orderkey", fn.average_text("total", "count").alias("average"))


@query
def chat_member_count(spark, sf):
    return relational.chat_member_count(fx.users_chats(spark, sf))


@query
def valid_session_count(spark, sf):
    return relational.valid_session_count(fx.sessions(spark, sf), fx.NOW_MS)


@query
def chats_per_user(spark, sf):
    return relational.chats_per_user(fx.users_chats(spark, sf))


@query
def read_count(spark, sf):
    return cur.read_count(fx.users_chats(spark, sf), fx.OFFSETS)


@query
def vertex_count(spark, sf):
    return graph.count_vertices(_graph_vertices(spark, sf), F.col("name").endswith("7"))


@query
def edge_count(spark, sf):
    return graph.count_descending_edges(fx.shipment_edges(spark, sf))


# --- windows --------------------------------------------------------------------------


def _panes(spark, sf):
    """One stored table of panes by user and zone."""
    panes = windows.delay_panes(fx.delay_messages(spark, sf), "user_id", "zone_id")
    return materialize(panes, scratch_path(spark, "panes"))


@query
def avg_delay_by_user_panes(spark, sf):
    return windows.delay_from_panes(windows.delay_panes(fx.delay_messages(spark, sf), "user_id"), "user_id")


@query
def delay_metrics_panes(spark, sf):
    """Delay by user and by zone, and the number of messages, from one table of panes."""
    panes = _panes(spark, sf)
    by = [windows.delay_from_panes(panes, key).withColumnRenamed(key, "key").withColumn("metric", F.lit(key)) for key in ("user_id", "zone_id")]
    count = windows.num_messages_from_panes(panes).withColumn("avg_diff_time_ms", F.col("num_of_messages_per_time").cast("double"))
    count = count.drop("num_of_messages_per_time").withColumns({"key": F.lit("all"), "metric": F.lit("messages")})
    return by[0].unionByName(by[1]).unionByName(count).select("window_start", "window_end", "metric", "key", F.col("avg_diff_time_ms").alias("value"))


@query
def avg_delay(spark, sf):
    return windows.avg_delay(fx.delay_messages(spark, sf))


@query
def avg_delay_by_user(spark, sf):
    return windows.avg_delay_by_user(fx.delay_messages(spark, sf))


@query
def avg_delay_by_zone(spark, sf):
    return windows.avg_delay_by_zone(fx.delay_messages(spark, sf))


@query
def num_messages(spark, sf):
    return windows.num_messages(fx.delay_messages(spark, sf))


@query
def avg_words_1m_per_user(spark, sf):
    return windows.split_window(windows.avg_words_windowed(fx.document_messages(spark, sf), "user_id"))


@query
def avg_words_1m_per_zone(spark, sf):
    return windows.split_window(windows.avg_words_windowed(fx.document_messages(spark, sf), "zone_id"))


@query
def avg_words_1m_per_chat(spark, sf):
    return windows.split_window(windows.avg_words_windowed(fx.word_messages(spark, sf), "chat_id"))


@query
def words_all_keys(spark, sf):
    """Words by user, zone and chat from one scan."""
    return windows.words_by(fx.document_messages(spark, sf), {"user": "user_id", "zone": "zone_id", "chat": "chat_id"})


@query
def delays_all_keys(spark, sf):
    """Delays over all, by user and by zone from one scan."""
    return windows.delays_by(fx.delay_messages(spark, sf), {"all": None, "user": "user_id", "zone": "zone_id"})


@query
def msg_count_total(spark, sf):
    return windows.msg_count(fx.word_messages(spark, sf))


@query
def msg_count_by_zone(spark, sf):
    return windows.msg_count(fx.word_messages(spark, sf), "zone_id", "1 second", "0 seconds")


@query
def msg_count_by_user(spark, sf):
    return windows.msg_count(fx.delay_messages(spark, sf), "user_id", "2 seconds", "5 seconds")


@query
def msg_count_by_chat_type(spark, sf):
    counts = windows.msg_count(fx.delay_messages(spark, sf), windows.chat_type())
    return counts.withColumn("chat_type", F.col("chat_type").cast("int"))


@query
def msg_count_by_chat(spark, sf):
    return windows.msg_count(fx.word_messages(spark, sf), "chat_id")


@query
def late_records(spark, sf):
    return windows.late_records(fx.message_log(spark, sf), "offset", key_space=["chat_id", "partition"])


@query
def late_records_cut(spark, sf):
    """The same with blocks of two records, so that every key space is cut."""
    return windows.late_records(fx.message_log(spark, sf), "offset", key_space=["chat_id", "partition"], rows_per_block=2)


@query
def msg_count_by_chat_on_time(spark, sf):
    kept = windows.on_time(fx.message_log(spark, sf), "offset", key_space=["chat_id", "partition"])
    return windows.msg_count(kept, "chat_id", "60 seconds")


# --- cursors --------------------------------------------------------------------------


def _positions(spark, sf):
    return cur.cursors(fx.users_chats(spark, sf), fx.OFFSETS)


@query
def unread_messages(spark, sf):
    return cur.unread_messages(fx.message_log(spark, sf), _positions(spark, sf))


@query
def unread_ranges(spark, sf):
    ranges = cur.unread_ranges(fx.message_log(spark, sf), _positions(spark, sf))
    return ranges.withColumns({name: F.coalesce(name, F.lit(-1)) for name in ("last_offset", "newest_ms")})


@query
def unread_count(spark, sf):
    counts = cur.unread_count(fx.message_log(spark, sf), _positions(spark, sf))
    return counts.withColumn("newest_ms", F.coalesce("newest_ms", F.lit(-1)))


@query
def unread_count_cut(spark, sf):
    """The same with blocks of two offsets."""
    counts = cur.unread_count(fx.message_log(spark, sf), _positions(spark, sf), per_block=2)
    return counts.withColumn("newest_ms", F.coalesce("newest_ms", F.lit(-1)))


def _laid_out(spark, sf):
    """The log in cells of four offsets, so that partitions of the sample have several."""
    return layout.lay_out(fx.message_log(spark, sf), per_cell=4)


@query
def unread_count_bucketed(spark, sf):
    """The same on a laid-out log, whose records are not shuffled."""
    counts = cur.unread_count(_laid_out(spark, sf), _positions(spark, sf))
    return counts.withColumn("newest_ms", F.coalesce("newest_ms", F.lit(-1)))


@query
def unread_messages_bucketed(spark, sf):
    return cur.unread_messages(_laid_out(spark, sf), _positions(spark, sf))


@query
def records_since(spark, sf):
    """What a reader that starts from the stored positions fetches."""
    return cur.records_since(fx.message_log(spark, sf), _positions(spark, sf))


@query
def records_since_bucketed(spark, sf):
    return cur.records_since(_laid_out(spark, sf), _positions(spark, sf))


@query
def history_page(spark, sf):
    return cur.history_page(fx.message_log(spark, sf), _positions(spark, sf))


@query
def history_page_bucketed(spark, sf):
    return cur.history_page(_laid_out(spark, sf), _positions(spark, sf))


@query
def history_page_second(spark, sf):
    return cur.history_page(fx.message_log(spark, sf), _positions(spark, sf), page=1, page_size=1)


@query
def next_offsets(spark, sf):
    return cur.next_offsets(fx.message_log(spark, sf), _positions(spark, sf))


@query
def next_offsets_bucketed(spark, sf):
    """The same from the summary of cells, without a look at the records."""
    return cur.next_offsets(_laid_out(spark, sf), _positions(spark, sf))


@query
def apply_offset_updates(spark, sf):
    return cur.apply_offset_updates(fx.users_chats(spark, sf), fx.offset_updates(spark, sf), fx.OFFSETS)


@query
def invitation_backlog(spark, sf):
    return cur.invitation_backlog(fx.invitations(spark, sf), fx.settings(spark, sf))


@query
def next_joining_offset(spark, sf):
    return cur.next_joining_offsets(fx.invitations(spark, sf), fx.settings(spark, sf))


@query
def mark_read(spark, sf):
    return cur.mark_read(fx.message_log(spark, sf), fx.users_chats(spark, sf), fx.OFFSETS)


@query
def new_chats_from_invitations(spark, sf):
    return cur.new_chats_from_invitations(fx.invitations(spark, sf), fx.users_chats(spark, sf), fx.OFFSETS)


@query
def typing_now(spark, sf):
    return cur.typing_now(fx.writing(spark, sf))


@query
def typing_intervals(spark, sf):
    """Signals of one writer in a chat go on with an interval for an hour."""
    return cur.typing_intervals(fx.writing(spark, sf), "1 hour")


# --- orders and merging ---------------------------------------------------------------


@query
def chat_list_order(spark, sf):
    return cur.chat_list_order(fx.message_log(spark, sf), fx.users_chats(spark, sf), fx.OFFSETS)


@query
def chat_list_order_bucketed(spark, sf):
    return cur.chat_list_order(_laid_out(spark, sf), fx.users_chats(spark, sf), fx.OFFSETS)


@query
def chat_list_order_cut(spark, sf):
    """The same in 64 ranges and blocks of two offsets, so that users and partitions are cut."""
    return cur.chat_list_order(fx.message_log(spark, sf), fx.users_chats(spark, sf), fx.OFFSETS, per_block=2, pieces=64)


@query
def timeline(spark, sf):
    return cur.timeline(fx.message_log(spark, sf))


@query
def unread_in_time_order(spark, sf):
    return cur.unread_in_time_order(fx.message_log(spark, sf), _positions(spark, sf)).select(
        "user_id", "server_time", "chat_id", "partition", "offset"
    )


@query
def chats_by_last_message(spark, sf):
    return cur.chats_by_last_message(fx.users_chats(spark, sf), newest_first=True).select(
        "user_id", "chat_id", "message_time"
    )


@query
def merge_old_new(spark, sf):
    records = fx.message_log(spark, sf)
    loaded = records.filter(F.col("server_time") >= F.lit("1998-01-01").cast("timestamp"))
    older = records.filter(F.col("server_time") < F.lit("1999-01-01").cast("timestamp"))
    return cur.merge_old_new(loaded, older)


@query
def merge_old_new_streamed(spark, sf):
    """The same on two streams; the older page comes first here, and its records again with the loaded ones."""
    root, records = scratch_path(spark, "merge"), fx.message_log(spark, sf)
    records = records.withColumn("server_time", F.col("server_time").cast("timestamp"))
    records.filter(F.col("server_time") >= F.lit("1998-01-01").cast("timestamp")).write.parquet(f"{root}/loaded")
    records.filter(F.col("server_time") < F.lit("1999-01-01").cast("timestamp")).write.parquet(f"{root}/older")
    streams = [spark.readStream.schema(records.schema).parquet(f"{root}/{name}") for name in ("loaded", "older")]
    run_available(to_table(cur.merge_old_new_stream(*streams, "4000 days"), f"{root}/table"), "merged", root)
    return spark.read.parquet(f"{root}/table").select(*records.columns)


# --- graph ----------------------------------------------------------------------------


@query
def vertices(spark, sf):
    return graph.vertices(fx.users(spark, sf))


@query
def co_membership_edges(spark, sf):
    return graph.co_membership_edges(graph.graph_membership(fx.users(spark, sf), fx.users_chats(spark, sf)))


def _ranks(spark, sf, name):
    ranks = graph.page_ranks(fx.users(spark, sf), fx.users_chats(spark, sf))
    return ranks.select("user_num_id", F.round(name, 6).alias(name))


@query
def pagerank(spark, sf):
    return _ranks(spark, sf, "rank_forward")


@query
def pagerank_cut(spark, sf):
    """Forward ranks with memberships in 64 ranges, so that chats are cut."""
    ranks = graph.page_ranks(fx.users(spark, sf), fx.users_chats(spark, sf), pieces=64)
    return ranks.select("user_num_id", F.round("rank_forward", 6).alias("rank_forward"))


@query
def pagerank_reversed(spark, sf):
    return _ranks(spark, sf, "rank_reversed")


@query
def pagerank_symmetric(spark, sf):
    return _ranks(spark, sf, "page_rank")


@query
def saved_ranks(spark, sf):
    """Ranks as a stored table: a run of both directions replaces one that knew the forward edges only."""
    found = graph.page_ranks(fx.users(spark, sf), fx.users_chats(spark, sf))
    held = RankTable(spark, scratch_path(spark, "rank-table"))
    held.save(found.withColumn("page_rank", F.col("rank_forward")))
    held.save(found)
    return held.ranks().select("user_num_id", F.round("page_rank", 6).alias("page_rank"))


# --- scalar functions -----------------------------------------------------------------


@query
def word_count(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fn.count_words("text").alias("words"))


@query
def local_time(spark, sf):
    return fx.delay_messages(spark, sf).select(
        "arrival", fn.local_time_text(F.unix_millis("server_time"), "zone_id").alias("local_time")
    )


@query
def parse_session_token(spark, sf):
    parsed = fx.session_tokens(spark, sf).withColumn("_parsed", fn.session_token("token"))
    return parsed.select(
        "token",
        F.col("_parsed.session_id").alias("session_id"),
        F.col("_parsed.user_id").alias("user_id"),
        F.col("_parsed.validity_time").cast("string").alias("validity_time"),
    )


@query
def valid_chat_name(spark, sf):
    return fx.names(spark, sf).select("name", fn.is_valid_chat_name("name").alias("valid"))


@query
def invalid_login(spark, sf):
    return fx.names(spark, sf).select("name", fn.is_invalid_login("name").alias("invalid"))


@query
def session_expiry(spark, sf):
    return relational.session_expiries(fx.users(spark, sf), fx.settings(spark, sf), fx.NOW_MS)


@query
def offsets_array(spark, sf):
    listed = fx.users_chats(spark, sf).select("user_id", "chat_id", F.inline(fn.offsets_array(fx.OFFSETS)))
    return listed


# --- routing and encoding -------------------------------------------------------------


@query
def route_inbound(spark, sf):
    return routing.route_inbound(fx.inbound_json(spark, sf)).select(
        "arrival",
        "kind",
        F.coalesce("parsed.chatId", "parsed.message.chatId").alias("chat_id"),
        F.coalesce("parsed.userId", "parsed.user.userId", "parsed.me.userId").alias("sender"),
    )


@query
def route_outbound(spark, sf):
    return routing.route_outbound(fx.outbound_json(spark, sf), me="user_id").select(
        "arrival", F.array_join("kinds", ",").alias("kinds")
    )


@query
def decode_commands(spark, sf):
    return routing.decode_commands(fx.command_json(spark, sf)).select(
        "arrival", "command", F.col("parsed.chatName").alias("chat_name")
    )


@query
def route_inbound_variant(spark, sf):
    routed = variants.route_inbound(variants.parse(fx.inbound_json(spark, sf)))
    first = [F.try_variant_get("json", f"$.{path}", "string") for path in ("chatId", "message.chatId", "userId", "user.userId", "me.userId")]
    return routed.select("arrival", "kind", F.coalesce(*first[:2]).alias("chat_id"), F.coalesce(*first[2:]).alias("sender"))


@query
def route_outbound_variant(spark, sf):
    routed = variants.route_outbound(variants.parse(fx.outbound_json(spark, sf)), me="user_id")
    return routed.select("arrival", F.array_join("kinds", ",").alias("kinds"))


@query
def decode_commands_variant(spark, sf):
    decoded = variants.decode_commands(variants.parse(fx.command_json(spark, sf)))
    return decoded.select("arrival", "command", F.try_variant_get("json", "$.chatName", "string").alias("chat_name"))


@query
def encode_profile(spark, sf):
    profile = relational.user_profile(
        fx.profile_users(spark, sf), fx.profile_settings(spark, sf), fx.users_chats(spark, sf), fx.chats(spark, sf)
    )
    return relational.encode_profile(profile, chats_per_page=10)


@query
def encode_chats(spark, sf):
    return relational.encode_chats(relational.my_chats(fx.users_chats(spark, sf), fx.chats(spark, sf)))
