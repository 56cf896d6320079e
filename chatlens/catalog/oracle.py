"""The queries of ``catalog.queries`` as plain SQL, to be run by another engine."""

from __future__ import annotations

from chatlens.catalog.fixture_sql import half_even, ms, uuid_of, with_views, words
from chatlens.sources.fixtures import NOW_MS

_OFFSETS = "uc.users_offset_0, uc.users_offset_1, uc.users_offset_2"
_CHAT = "uc.user_id, uc.chat_id, uc.chat_name, c.group_chat, uc.message_time, uc.silent, " + _OFFSETS
_SLIDE_END = "window_start + INTERVAL 60 SECOND AS window_end"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"
_ROUNDED = "CAST(round(CAST(sum(diff_time_ms) AS DOUBLE) / count(*)) AS BIGINT)"
_AVERAGE = "CAST(sum(diff_time_ms) AS DOUBLE) / count(*) AS avg_diff_time_ms"


def _delay(key: str = "", where: str = "") -> str:
    keys = f", {key}" if key else ""
    return f"""SELECT window_start, {_SLIDE_END}{keys}, {_AVERAGE} FROM sliding {where}
               GROUP BY window_start{keys}"""


# A window has left the stream once the watermark, 30 s behind the latest record, passed its end.
_CLOSED = """WHERE window_start + INTERVAL 60 SECOND <=
             (SELECT max(server_time) - INTERVAL 30 SECOND FROM delay_messages)"""


def _words(source: str, key: str, windowed: bool = False) -> str:
    window = "time_bucket(INTERVAL 60 SECOND, server_time)"
    bounds = f"{window} AS window_start, {window} + INTERVAL 60 SECOND AS window_end, " if windowed else ""
    return f"""SELECT {bounds}{key}, CAST(sum(w) AS BIGINT) AS words, count(w) AS messages,
                      {half_even('sum(w)', 'count(w)')} AS avg_words
               FROM (SELECT *, {words('content')} AS w FROM {source}) AS counted GROUP BY ALL"""


def _count(source: str, seconds: int, key: str = "", name: str = "") -> str:
    window = f"time_bucket(INTERVAL {seconds} SECOND, server_time)"
    extra = f", {key} AS {name or key}" if key else ""
    return f"""SELECT {window} AS window_start, {window} + INTERVAL {seconds} SECOND AS window_end{extra},
                      count(*) AS messages FROM {source} GROUP BY ALL"""


_LATENESS = f"""
    SELECT *, max({ms('server_time')}) OVER (PARTITION BY chat_id, "partition" ORDER BY "offset"
                ROWS UNBOUNDED PRECEDING) AS stream_time_ms,
           {ms('server_time')} // 60000 * 60000 + 60000 AS window_end_ms
    FROM message_log"""


def _rank(name: str) -> str:
    def side(tag: str, src: str, dst: str) -> str:
        return f"""
        {tag}_weights AS (
            SELECT {src} AS src, {dst} AS dst,
                   CAST(count(*) AS DOUBLE) / (sum(count(*)) OVER (PARTITION BY {src})) AS weight
            FROM edges GROUP BY {src}, {dst}),
        {tag}_flow AS (
            SELECT 0 AS step, user_num_id AS id, CAST(0.15 AS DOUBLE) AS change FROM users
            UNION ALL
            SELECT f.step + 1, w.dst, 0.85 * sum(f.change * w.weight)
            FROM {tag}_flow f JOIN {tag}_weights w ON w.src = f.id
            WHERE f.change > 0.001 GROUP BY f.step, w.dst),
        {tag}_sums AS (SELECT id, sum(change) AS rank FROM {tag}_flow GROUP BY id),
        {tag}_ranks AS (
            SELECT id, rank * (SELECT count(*) FROM users) / (SELECT sum(rank) FROM {tag}_sums) AS rank FROM {tag}_sums)"""

    value = {"rank_forward": "f.rank", "rank_reversed": "b.rank", "page_rank": "(f.rank + b.rank) / 2"}[name]
    return f"""WITH_RECURSIVE {side('down', 'src', 'dst')}, {side('up', 'dst', 'src')}
        SELECT f.id AS user_num_id, round({value}, 6) AS {name}
        FROM down_ranks f JOIN up_ranks b ON f.id = b.id /* FROM edges, users */"""


def _profile_json() -> str:
    entry = """'{"chat":{"chatId":"' || uc.chat_id || '","chatName":"' || uc.chat_name || '","groupChat":' || c.group_chat
        || ',"lastMessageTime":' || uc.message_time || ',"silent":' || uc.silent || '},"partitionOffsets":['
        || '{"partition":0,"offset":' || users_offset_0 || '},{"partition":1,"offset":' || users_offset_1
        || '},{"partition":2,"offset":' || users_offset_2 || '}]}'"""
    return entry


_ENTRY = _profile_json()

_BODIES: dict[str, str] = {
    # sources and sinks
    "src_chat_log": """SELECT topic, part AS "partition", off AS "offset", ts AS "timestamp" FROM envelopes
        WHERE regexp_full_match(topic, 'chat--([[:alnum:]-]*)')""",
    "decode_message": """SELECT server_time, chat_id, chat_name, group_chat, zone_id,
        make_timestamp(epoch_us(message_time) // 1000 * 1000) AS message_time, content, user_id, login
        FROM delay_messages""",
    "enrich_from_envelope": f"""SELECT chat_id AS "chatId", user_id AS "authorId", {ms('server_time')} AS "serverTime",
        0 AS part, arrival AS off FROM delay_messages""",
    "src_tables": "SELECT user_id, user_num_id, login FROM users",
    "sink_log": """SELECT '{"window_start":"' || strftime(window_start, '%Y-%m-%dT%H:%M:%S.000Z')
        || '","window_end":"' || strftime(window_start + INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%S.000Z')
        || '","num_of_messages_per_time":' || count(*) || '}' AS value FROM sliding GROUP BY window_start""",
    "sink_table": _delay("user_id", _CLOSED),
    "sink_csv": _delay("zone_id", _CLOSED),
    "stream_avg_words_updates": _words("delay_messages", "zone_id", windowed=True),
    "encode_delay": f"""SELECT '{{"window_start":"' || strftime(window_start, {_ISO}) || '","window_end":"'
        || strftime(window_start + INTERVAL 60 SECOND, {_ISO}) || '","delay_ms":' || {_ROUNDED} || '}}' AS value
        FROM sliding GROUP BY window_start""",
    **{
        f"encode_delay_by_{short}": f"""SELECT '{{"window_start":"' || strftime(window_start, {_ISO}) || '","window_end":"'
        || strftime(window_start + INTERVAL 60 SECOND, {_ISO}) || '","{key}":"' || {key} || '","delay_ms":' || {_ROUNDED}
        || '}}' AS value FROM sliding GROUP BY window_start, {key}"""
        for short, key in (("user", "user_id"), ("zone", "zone_id"))
    },
    "encode_keyed_result": f"""SELECT strftime(time_bucket(INTERVAL 60 SECOND, server_time), {_ISO}) || '___' || zone_id AS key,
        {half_even('sum(w)', 'count(w)')} AS value
        FROM (SELECT *, {words('content')} AS w FROM word_messages) AS counted
        GROUP BY time_bucket(INTERVAL 60 SECOND, server_time), zone_id""",
    # projections and filters
    "delivery_delay": "SELECT user_id, server_time, diff_time_ms FROM delays",
    "split_window": _count("document_messages", 60, "zone_id"),
    "split_window_text": """SELECT strftime(time_bucket(INTERVAL 60 SECOND, server_time), '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(time_bucket(INTERVAL 60 SECOND, server_time) + INTERVAL 60 SECOND, '%Y-%m-%d %H:%M:%S') AS window_end,
        count(*) AS messages FROM document_messages GROUP BY ALL""",
    "active_sessions": f"SELECT * FROM sessions WHERE validity_time > {NOW_MS}",
    "purge_expired_sessions": f"""SELECT s.user_id, s.session_id, s.validity_time FROM sessions s
        LEFT JOIN users u ON u.user_id = s.user_id
        WHERE u.user_id IS NULL OR s.validity_time >= {NOW_MS} - u.user_num_id * 3600000""",
    "search_users": "SELECT pattern, user_id, login FROM search_hits",
    "user_sessions": "SELECT * FROM sessions WHERE user_id IN (SELECT user_id FROM users)",
    "topic_filter": """SELECT DISTINCT topic, regexp_full_match(topic, 'chat--([[:alnum:]-]*)') AS is_chat FROM envelopes""",
    "user_by_login": "SELECT user_id, login FROM users WHERE login IN (SELECT login FROM wanted_logins)",
    "user_exists": """SELECT w.user_id, w.login FROM wanted_logins w WHERE NOT EXISTS
        (SELECT 1 FROM users u WHERE u.user_id = w.user_id AND u.login = w.login)""",
    # joins
    "user_profile_chats": f"""SELECT p.login, p.joining_offset, p.session_duration, p.zone_id, {_CHAT}
        FROM profile p JOIN users_chats uc ON uc.user_id = p.user_id JOIN chats c ON c.chat_id = uc.chat_id""",
    "user_profile": """SELECT p.user_id, p.login, p.joining_offset, p.session_duration, p.zone_id, uc.chat_id, uc.chat_name,
        CAST(c.group_chat AS VARCHAR) AS group_chat, CAST(uc.message_time AS VARCHAR) AS message_time,
        CAST(uc.silent AS VARCHAR) AS silent, CAST(users_offset_0 AS VARCHAR) AS users_offset_0,
        CAST(users_offset_1 AS VARCHAR) AS users_offset_1, CAST(users_offset_2 AS VARCHAR) AS users_offset_2
        FROM full_profile p
        LEFT JOIN (users_chats uc JOIN chats c ON c.chat_id = uc.chat_id) ON uc.user_id = p.user_id
        /* FROM users_chats */""",
    "chat_members": """SELECT uc.chat_id, u.user_id, u.login FROM users_chats uc JOIN users u ON u.user_id = uc.user_id""",
    "chat_data": f"SELECT {_CHAT} FROM users_chats uc JOIN chats c ON c.chat_id = uc.chat_id",
    "my_chats": f"""SELECT DISTINCT {_CHAT} FROM users_chats uc JOIN chats c ON c.chat_id = uc.chat_id
        JOIN users_chats oc ON oc.chat_id = c.chat_id JOIN users u ON u.user_id = oc.user_id
        WHERE u.user_id = uc.user_id""",
    "chats_with_members": """SELECT chat_id, group_chat, page,
               string_agg(user_id || ':' || login, ',' ORDER BY user_id) AS members
        FROM (SELECT uc.chat_id, c.group_chat, u.user_id, u.login,
                     CAST((row_number() OVER (PARTITION BY uc.chat_id ORDER BY u.user_id) - 1) // 5 AS INTEGER) AS page
              FROM users_chats uc JOIN chats c ON c.chat_id = uc.chat_id JOIN users u ON u.user_id = uc.user_id) AS paged
        GROUP BY chat_id, group_chat, page""",
    "graph_membership": "SELECT chat_id, id FROM members",
    "invite_candidates": """SELECT m.chat_id || '/' || m.user_id AS request_id, m.chat_id, u.user_id, u.login
        FROM users_chats m JOIN users u ON u.user_num_id = CAST(m.user_id AS BIGINT) + 1
        WHERE u.user_id NOT IN (SELECT user_id FROM settings WHERE zone_id = 'UTC')
          AND NOT EXISTS (SELECT 1 FROM users_chats o WHERE o.chat_id = m.chat_id AND o.user_id = u.user_id)
        /* FROM users_chats, settings */""",
    "duplicate_direct_chat": """SELECT first_user, second_user, count(*) AS chats, min(chat_id) AS kept_chat
        FROM direct_pairs GROUP BY ALL HAVING count(*) > 1""",
    "existing_direct_chat": """SELECT w.chat_id FROM (
          SELECT 'chat--' || user_id || '--' || (user_num_id + 1000000) AS chat_id, user_id AS a,
                 CAST(user_num_id + 1000000 AS VARCHAR) AS b FROM users
          UNION ALL SELECT 'chat--' || (user_num_id + 1000000) || '--' || user_id, user_id,
                 CAST(user_num_id + 1000000 AS VARCHAR) FROM users) w
        WHERE EXISTS (SELECT 1 FROM direct_pairs d WHERE d.first_user = least(w.a, w.b) AND d.second_user = greatest(w.a, w.b))""",
    "triplets": """SELECT e.src, e.dst, s.name || ' is the ' || e.relation || ' of ' || d.name AS fact
        FROM shipment_edges e JOIN graph_vertices s ON s.id = e.src JOIN graph_vertices d ON d.id = e.dst""",
    "default_vertex": "SELECT id, name FROM graph_vertices",
    "rank_join": """SELECT p.id, coalesce((p.rank + s.rank) / 2, p.rank) AS rank
        FROM (SELECT l_partkey AS id, CAST(count(*) AS DOUBLE) AS rank FROM lineitem GROUP BY l_partkey) p
        LEFT JOIN (SELECT l_suppkey AS id, CAST(count(*) AS DOUBLE) AS rank FROM lineitem GROUP BY l_suppkey) s ON s.id = p.id""",
    # aggregates
    "avg_words_per_user": _words("document_messages", "user_id"),
    "avg_words_per_zone": _words("document_messages", "zone_id"),
    "average_num": f"""SELECT l_orderkey, {half_even('sum(l_partkey)', "count(*) FILTER (WHERE l_returnflag = 'A')")} AS average
        FROM lineitem GROUP BY l_orderkey""",
    "chat_member_count": "SELECT chat_id, count(*) AS members FROM users_chats GROUP BY chat_id",
    "valid_session_count": f"""SELECT user_id, count(*) AS sessions FROM sessions WHERE validity_time > {NOW_MS}
        GROUP BY user_id""",
    "chats_per_user": "SELECT user_id, count(*) AS chats FROM users_chats GROUP BY user_id",
    "read_count": "SELECT user_id, chat_id, users_offset_0 + users_offset_1 + users_offset_2 AS read FROM users_chats",
    "vertex_count": "SELECT count(*) AS vertices FROM users WHERE login LIKE '%7'",
    "edge_count": "SELECT count(*) AS edges FROM shipment_edges WHERE src > dst",
    # windows
    "avg_delay": f"""SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(window_start + INTERVAL 60 SECOND, '%Y-%m-%d %H:%M:%S') AS window_end, {_AVERAGE}
        FROM sliding GROUP BY sliding.window_start""",
    "avg_delay_by_user": _delay("user_id"),
    "avg_delay_by_zone": _delay("zone_id"),
    "num_messages": f"""SELECT window_start, {_SLIDE_END}, count(*) AS num_of_messages_per_time FROM sliding
        GROUP BY window_start""",
    "avg_words_1m_per_user": _words("document_messages", "user_id", windowed=True),
    "avg_words_1m_per_zone": _words("document_messages", "zone_id", windowed=True),
    "avg_words_1m_per_chat": _words("word_messages", "chat_id", windowed=True),
    "words_all_keys": " UNION ALL ".join(
        f"""SELECT window_start, window_end, '{name}' AS metric, CAST({key} AS VARCHAR) AS key, words, messages, avg_words
        FROM ({_words("document_messages", key, windowed=True)}) AS {name}_words"""
        for name, key in (("user", "user_id"), ("zone", "zone_id"), ("chat", "chat_id"))
    ),
    "delays_all_keys": " UNION ALL ".join(
        f"""SELECT window_start, {_SLIDE_END}, '{name}' AS metric, {key} AS key, {_AVERAGE}, count(*) AS messages
        FROM sliding GROUP BY window_start, {group}"""
        for name, key, group in (
            ("all", "CAST(NULL AS VARCHAR)", "1 + 0"), ("user", "CAST(user_id AS VARCHAR)", "user_id"), ("zone", "zone_id", "zone_id"))
    ).replace(", 1 + 0", ""),
    "msg_count_total": _count("word_messages", 2),
    "msg_count_by_zone": _count("word_messages", 1, "zone_id"),
    "msg_count_by_user": _count("delay_messages", 2, "user_id"),
    "msg_count_by_chat_type": _count("delay_messages", 2, "CAST(group_chat AS INTEGER)", "chat_type"),
    "msg_count_by_chat": _count("word_messages", 2, "chat_id"),
    "late_records": f"SELECT * FROM ({_LATENESS}) AS marked WHERE window_end_ms + 5 <= stream_time_ms",
    "msg_count_by_chat_on_time": _count(
        f"(SELECT * FROM ({_LATENESS}) AS marked WHERE window_end_ms + 5 > stream_time_ms) AS kept", 60, "chat_id"
    ),
    # cursors
    "unread_messages": "SELECT * FROM unread",
    "unread_ranges": """SELECT user_id, chat_id, "partition", "offset", unread,
        coalesce(last_offset, -1) AS last_offset, coalesce(newest_ms, -1) AS newest_ms FROM unread_parts""",
    "unread_count": "SELECT user_id, chat_id, unread, coalesce(newest_ms, -1) AS newest_ms FROM unread_chats",
    **{
        name: f"""SELECT p.user_id, m.* FROM message_log m JOIN positions p
        ON p.chat_id = m.chat_id AND p."partition" = m."partition"
        AND m."offset" >= greatest(p."offset" - {skipped} - {size}, 0) AND m."offset" < greatest(p."offset" - {skipped}, 0)"""
        for name, skipped, size in (("history_page", 0, 15), ("history_page_second", 1, 1))
    },
    "next_offsets": """SELECT p.user_id, p.chat_id, p."partition", greatest(p."offset", m.next) AS "offset" FROM positions p
        LEFT JOIN (SELECT chat_id, "partition", max("offset") + 1 AS next FROM message_log GROUP BY ALL) m
        ON m.chat_id = p.chat_id AND m."partition" = p."partition" """,
    "apply_offset_updates": """SELECT uc.user_id, uc.chat_id, uc.chat_name, uc.silent,
            CASE WHEN b.total > stored THEN b.last_message_time ELSE uc.message_time END AS message_time,
            CASE WHEN b.total > stored THEN b.o0 + 1 ELSE users_offset_0 END AS users_offset_0,
            CASE WHEN b.total > stored THEN b.o1 + 1 ELSE users_offset_1 END AS users_offset_1,
            CASE WHEN b.total > stored THEN b.o2 + 1 ELSE users_offset_2 END AS users_offset_2
        FROM (SELECT *, users_offset_0 + users_offset_1 + users_offset_2 AS stored FROM users_chats) uc
        LEFT JOIN (SELECT *, o0 + o1 + o2 AS total, row_number() OVER (PARTITION BY user_id, chat_id
                   ORDER BY o0 + o1 + o2 DESC, l_linenumber, l_partkey, l_extendedprice) AS nth FROM offset_updates) b
        ON b.user_id = uc.user_id AND b.chat_id = uc.chat_id AND b.nth = 1""",
    "invitation_backlog": """SELECT i.*, i."offset" + 1 AS my_joining_offset FROM invitations i
        JOIN settings s ON s.user_id = i.user_id WHERE i."offset" >= s.joining_offset""",
    "next_joining_offset": """SELECT s.user_id, greatest(s.joining_offset, i.next) AS joining_offset FROM settings s
        LEFT JOIN (SELECT user_id, max("offset") + 1 AS next FROM invitations GROUP BY user_id) i ON i.user_id = s.user_id""",
    "mark_read": """SELECT r.user_id, r.chat_id, greatest(max(uc.message_time), max(r.newest_ms)) AS message_time,
            max(greatest(r."offset", r.last_offset)) FILTER (WHERE r."partition" = 0) AS users_offset_0,
            max(greatest(r."offset", r.last_offset)) FILTER (WHERE r."partition" = 1) AS users_offset_1,
            max(greatest(r."offset", r.last_offset)) FILTER (WHERE r."partition" = 2) AS users_offset_2
        FROM unread_parts r JOIN users_chats uc ON uc.user_id = r.user_id AND uc.chat_id = r.chat_id
        GROUP BY r.user_id, r.chat_id""",
    "new_chats_from_invitations": """SELECT user_id, chat_id, chat_name, login AS invited_by,
            CAST(0 AS BIGINT) AS users_offset_0, CAST(0 AS BIGINT) AS users_offset_1, CAST(0 AS BIGINT) AS users_offset_2
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, chat_id ORDER BY "offset", login, chat_name) AS nth
              FROM invitations) i
        WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM users_chats uc WHERE uc.user_id = i.user_id AND uc.chat_id = i.chat_id)""",
    "typing_now": """SELECT DISTINCT time_bucket(INTERVAL 1 SECOND, server_time) AS slot_start, chat_id,
        user_id AS writer_id, login AS writer_login FROM delay_messages""",
    # orders and merging
    "chat_list_order": """SELECT user_id, chat_id, sort_time,
            row_number() OVER (PARTITION BY user_id ORDER BY sort_time DESC, chat_id) AS position
        FROM (SELECT uc.user_id, uc.chat_id, coalesce(r.newest_ms, uc.message_time) AS sort_time
              FROM users_chats uc LEFT JOIN unread_chats r ON r.user_id = uc.user_id AND r.chat_id = uc.chat_id) AS keyed""",
    "timeline": "SELECT * FROM message_log",
    "unread_in_time_order": 'SELECT user_id, server_time, chat_id, "partition", "offset" FROM unread',
    "chats_by_last_message": "SELECT user_id, chat_id, message_time FROM users_chats",
    "merge_old_new": "SELECT * FROM message_log",
    # graph
    "vertices": "SELECT user_num_id AS id, user_id FROM users",
    "co_membership_edges": """SELECT m.chat_id, m.id, count(*) FILTER (WHERE o.id > m.id) AS out_edges,
            count(*) FILTER (WHERE o.id < m.id) AS in_edges
        FROM members m JOIN members o ON o.chat_id = m.chat_id GROUP BY m.chat_id, m.id""",
    "pagerank": _rank("rank_forward"),
    "pagerank_reversed": _rank("rank_reversed"),
    "pagerank_symmetric": _rank("page_rank"),
    "saved_ranks": _rank("page_rank"),
    # scalar functions
    "word_count": f"SELECT doc_id, {words('text')} AS words FROM documents",
    "local_time": """SELECT arrival, strftime(make_timestamp(epoch_us(server_time)) AT TIME ZONE 'UTC' AT TIME ZONE zone_id,
        '%A, %d/%m/%Y, %H:%M:%S') || ' GMT' || CASE WHEN minutes < 0 THEN '-' ELSE '+' END
        || lpad(CAST(abs(minutes) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(minutes) % 60 AS VARCHAR), 2, '0') AS local_time
        FROM (SELECT *, (epoch_us(make_timestamp(epoch_us(server_time)) AT TIME ZONE 'UTC' AT TIME ZONE zone_id)
                         - epoch_us(server_time)) // 60000000 AS minutes FROM delay_messages) AS zoned /* FROM delay_messages */""",
    "parse_session_token": """SELECT
            CASE shape WHEN 0 THEN sid || '__' || uid || '__' || validity_time WHEN 1 THEN sid || '__' || uid
              WHEN 2 THEN sid || '__' || plain || '__' || validity_time WHEN 3 THEN sid || '__' || uid || '__' || validity_time || 'x'
              ELSE sid || '__' || uid || '__' || validity_time || '__' END AS token,
            CASE WHEN shape IN (0, 4) THEN sid END AS session_id, CASE WHEN shape IN (0, 4) THEN uid END AS user_id,
            CASE WHEN shape IN (0, 4) THEN CAST(validity_time AS VARCHAR) END AS validity_time
        FROM tokens""",
    "valid_chat_name": r"SELECT name, regexp_full_match(name, '[\w]+[ \t\n\x0B\f\r\w]*') AS valid FROM typed_names",
    "invalid_login": """SELECT name, regexp_full_match(name,
        '([[:alnum:][:punct:]]*[[:punct:]]+[[:alnum:][:punct:]]*)|([0-9]+)') AS invalid FROM typed_names""",
    "session_expiry": f"""SELECT u.user_id, {NOW_MS} + s.session_duration AS validity_time FROM users u
        JOIN settings s ON s.user_id = u.user_id""",
    "offsets_array": 'SELECT user_id, chat_id, "partition", "offset" FROM positions',
    # routing and encoding
    "route_inbound": """SELECT arrival,
            ['writing', 'message', 'configuration', 'chat_offset_update', 'chat_partitions_offsets', 'session_info',
             'fetch_older', 'ping', 'stop', 'unparsed', 'unparsed'][arrival % 11 + 1] AS kind,
            CASE WHEN arrival % 11 IN (0, 1, 3, 4, 6) THEN chat_id END AS chat_id,
            CASE WHEN arrival % 11 IN (1, 2, 3, 5) THEN user_id END AS sender
        FROM delay_messages""",
    "route_outbound": """SELECT arrival, CASE arrival % 7 WHEN 0 THEN 'new_messages' WHEN 1 THEN 'old_messages'
            WHEN 2 THEN 'invitation' WHEN 3 THEN '' WHEN 4 THEN 'writing' WHEN 5 THEN 'opened'
            ELSE CASE WHEN arrival % 3 = 0 THEN '' ELSE 'error' END END AS kinds
        FROM delay_messages""",
    "decode_commands": """SELECT arrival, ['message', 'new_chat', 'unparsed', 'new_chat_users', 'unparsed'][arrival % 5 + 1] AS command,
            CASE WHEN arrival % 5 IN (1, 2, 3) THEN chat_name END AS chat_name
        FROM delay_messages""",
    "encode_profile": f"""SELECT user_id, page, '{{"user":{{"userId":"' || user_id || '","login":"' || login
            || '"}},"settings":{{"joiningOffset":' || joining_offset || ',"sessionDuration":' || session_duration
            || ',"zoneId":"' || zone_id || '"}},"chatList":[' || coalesce(string_agg(entry, ',' ORDER BY chat_id), '') || ']}}' AS json
        FROM (SELECT p.*, uc.chat_id, {_ENTRY} AS entry,
                CAST((row_number() OVER (PARTITION BY p.user_id ORDER BY uc.chat_id) - 1) // 10 AS INTEGER) AS page
              FROM full_profile p LEFT JOIN (users_chats uc JOIN chats c ON c.chat_id = uc.chat_id)
              ON uc.user_id = p.user_id) AS paged
        GROUP BY user_id, login, joining_offset, session_duration, zone_id, page /* FROM users_chats */""",
    "encode_chats": f"""SELECT uc.user_id, uc.chat_id, {_ENTRY} AS json FROM users_chats uc
        JOIN chats c ON c.chat_id = uc.chat_id""",
}


# The same results with a cut forced on every group.
for _name in ("unread_count", "chat_list_order", "late_records", "chats_with_members", "pagerank"):
    _BODIES[f"{_name}_cut"] = _BODIES[_name]
_BODIES["records_since"] = """SELECT m.* FROM message_log m
    JOIN (SELECT chat_id, "partition", min("offset") AS low FROM positions GROUP BY chat_id, "partition") p
    ON p.chat_id = m.chat_id AND p."partition" = m."partition" AND m."offset" >= p.low"""
_BODIES["records_since_bucketed"] = _BODIES["records_since"]
for _name in ("route_inbound", "route_outbound", "decode_commands"):
    _BODIES[f"{_name}_variant"] = _BODIES[_name]
_BODIES["purge_expired_sessions_by_day"] = _BODIES["purge_expired_sessions"]
_BODIES["purge_all_sessions_by_day"] = f"SELECT * FROM sessions WHERE validity_time >= {NOW_MS + 10_000_000}"
_BODIES["search_users_indexed"] = """SELECT pattern, user_id, login FROM users, (
        SELECT pattern FROM (VALUES ('supplier#0+1'), ('[1-3]0$'), ('99')) p(pattern)
        UNION SELECT right(c_name, 4) || '$' FROM customer) AS wanted
    WHERE regexp_matches(login, '(?i)' || pattern)"""
_BODIES["typing_intervals"] = """SELECT chat_id, user_id AS writer_id, min(login) AS writer_login, min(server_time) AS typing_from,
        max(server_time) + INTERVAL 1 HOUR AS typing_until, count(*) AS signals
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY chat_id, user_id ORDER BY server_time, arrival ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, CASE WHEN server_time <= lag(server_time) OVER (PARTITION BY chat_id, user_id ORDER BY server_time, arrival)
                    + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM delay_messages) AS marked) AS islands
    GROUP BY chat_id, user_id, island"""
_BODIES["merge_old_new_streamed"] = _BODIES["merge_old_new"]
_BODIES["avg_delay_by_user_panes"] = _BODIES["avg_delay_by_user"]
_BODIES["delay_metrics_panes"] = " UNION ALL ".join([
    *[f"SELECT window_start, window_end, '{key}' AS metric, {key} AS key, avg_diff_time_ms AS value FROM ({_delay(key)}) AS by_{key}"
      for key in ("user_id", "zone_id")],
    f"""SELECT window_start, {_SLIDE_END}, 'messages' AS metric, 'all' AS key, CAST(count(*) AS DOUBLE) AS value
        FROM sliding GROUP BY window_start""",
])
_BODIES["apply_offset_updates_streamed"] = _BODIES["apply_offset_updates"]
_BODIES["stream_updates_compacted"] = _BODIES["stream_avg_words_updates"]
_BODIES["late_records_streamed"] = f"""SELECT * FROM (
        SELECT chat_id, user_id, server_time, arrival,
            max({ms('server_time')}) OVER (PARTITION BY chat_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS stream_time_ms,
            {ms('server_time')} // 60000 * 60000 + 60000 AS window_end_ms
        FROM (SELECT chat_id, user_id, arrival,
                make_timestamp(epoch_us(server_time) - 1000 * (epoch_us(server_time) - epoch_us(message_time))) AS server_time
              FROM delay_messages) AS sent) AS marked WHERE window_end_ms + 5 <= stream_time_ms"""
for _name in ("unread_count", "unread_messages", "history_page", "next_offsets", "chat_list_order"):
    _BODIES[f"{_name}_bucketed"] = _BODIES[_name]


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in _BODIES.items()}
