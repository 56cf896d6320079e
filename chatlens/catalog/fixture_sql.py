"""The frames of ``sources.fixtures`` as SQL over the sample tables."""

from __future__ import annotations

import re

_UUID = (
    "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || "
    "substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
)


def uuid_of(text: str) -> str:
    return "(" + _UUID.format(f"md5({text})") + ")"


def ms(ts: str) -> str:
    """Epoch milliseconds, cut and not rounded."""
    return f"(epoch_us({ts}) // 1000)"


def words(text: str) -> str:
    trimmed = f"regexp_replace({text}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
    return f"CAST(length(regexp_replace({trimmed}, '[^ \\t\\n\\x0B\\f\\r]+', '', 'g')) + 1 AS INTEGER)"


def half_even(total: str, count: str) -> str:
    """Two decimals, ties to even, in whole numbers."""
    n, d = f"CAST({total} AS BIGINT)", f"greatest(CAST({count} AS BIGINT), 1)"
    floor, rest = f"(({n} * 100) // {d})", f"(({n} * 100) % {d})"
    up = f"CASE WHEN 2 * {rest} > {d} OR (2 * {rest} = {d} AND {floor} % 2 = 1) THEN 1 ELSE 0 END"
    hundredths = f"({floor} + {up})"
    return f"CAST({hundredths} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0')"


VIEWS: dict[str, str] = {
    "delay_messages": """
        SELECT e.ts AS server_time,
               'chat--' || (e.user_id % 20) AS chat_id,
               'Chat ' || (e.user_id % 20) AS chat_name,
               e.user_id % 2 = 1 AS group_chat,
               CASE e.event_type WHEN 'click' THEN 'Europe/Warsaw' WHEN 'view' THEN 'Europe/Paris'
                 WHEN 'purchase' THEN 'UTC' WHEN 'signup' THEN 'America/New_York'
                 WHEN 'error' THEN 'Asia/Tokyo' END AS zone_id,
               make_timestamp(epoch_us(e.ts) - CAST(floor(e.value) AS BIGINT) * 1000) AS message_time,
               e.props AS content,
               CAST(e.user_id AS VARCHAR) AS user_id,
               'User' || e.user_id AS login,
               e.event_id AS arrival
        FROM events e""",
    "delays": f"""
        SELECT user_id, zone_id, server_time,
               {ms('server_time')} - {ms('message_time')} AS diff_time_ms
        FROM delay_messages""",
    "sliding": """
        SELECT unnest([time_bucket(INTERVAL 30 SECOND, server_time),
                       time_bucket(INTERVAL 30 SECOND, server_time) - INTERVAL 30 SECOND]) AS window_start,
               user_id, zone_id, diff_time_ms
        FROM delays""",
    "envelopes": """
        SELECT CASE WHEN zone_id = 'Asia/Tokyo' THEN 'writing ' || chat_id ELSE chat_id END AS topic,
               0 AS part, arrival AS off, server_time AS ts
        FROM delay_messages""",
    "word_messages": """
        SELECT TIMESTAMP '2024-01-01' + to_seconds(CAST(conv_id * 20 + turn * 7 AS INTEGER)) AS server_time,
               CAST(conv_id AS VARCHAR) AS chat_id, role AS user_id, text AS content,
               CASE role WHEN 'system' THEN 'UTC' WHEN 'user' THEN 'Europe/Warsaw'
                 WHEN 'assistant' THEN 'Europe/Paris' END AS zone_id
        FROM conversations""",
    "document_messages": """
        SELECT TIMESTAMP '2024-01-01' + to_seconds(CAST(d.doc_id * 3 AS INTEGER)) AS server_time,
               d.source AS chat_id, CAST(d.doc_id % 50 AS VARCHAR) AS user_id, d.text AS content, d.lang AS zone_id
        FROM documents d""",
    "users": """
        SELECT CAST(s_suppkey AS VARCHAR) AS user_id, s_suppkey AS user_num_id, s_name AS login FROM supplier""",
    "settings": """
        SELECT CAST(s_suppkey AS VARCHAR) AS user_id, s_suppkey % 50 * 1000 AS joining_offset,
               CAST(900000 AS BIGINT) AS session_duration,
               ['UTC', 'Europe/Warsaw', 'Europe/Paris', 'America/New_York', 'Asia/Tokyo'][s_nationkey % 5 + 1] AS zone_id
        FROM supplier""",
    "users_chats": f"""
        SELECT CAST(l_suppkey AS VARCHAR) AS user_id, 'chat--' || l_orderkey AS chat_id,
               'Chat ' || l_orderkey AS chat_name, {ms('max(l_shipdate)')} AS message_time,
               l_suppkey % 7 = 0 AS silent,
               count(*) FILTER (WHERE l_linenumber % 3 = 0) AS users_offset_0,
               count(*) FILTER (WHERE l_linenumber % 3 = 1) AS users_offset_1,
               count(*) FILTER (WHERE l_linenumber % 3 = 2) AS users_offset_2
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "chats": """
        SELECT chat_id, count(*) > 2 AS group_chat FROM users_chats GROUP BY chat_id""",
    "full_profile": """
        SELECT * FROM profile UNION ALL
        SELECT 'c' || c_custkey, c_name, 0, 900000, 'UTC' FROM customer""",
    "message_log": """
        SELECT 'chat--' || l_orderkey AS chat_id, l_linenumber % 3 AS "partition",
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3
                 ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) - 1 AS "offset",
               l_shipdate AS server_time, CAST(l_suppkey AS VARCHAR) AS author_id,
               CAST(l_partkey AS VARCHAR) AS content
        FROM lineitem""",
    "positions": """
        SELECT user_id, chat_id, 0 AS "partition", users_offset_0 AS "offset" FROM users_chats
        UNION ALL SELECT user_id, chat_id, 1, users_offset_1 FROM users_chats
        UNION ALL SELECT user_id, chat_id, 2, users_offset_2 FROM users_chats""",
    "unread": """
        SELECT p.user_id, m.* FROM message_log m
        JOIN positions p ON p.chat_id = m.chat_id AND p."partition" = m."partition" AND m."offset" >= p."offset" """,
    "unread_parts": f"""
        SELECT p.user_id, p.chat_id, p."partition", p."offset", CAST(count(m.chat_id) AS BIGINT) AS unread,
               max(m."offset") AS last_offset, max({ms('m.server_time')}) AS newest_ms
        FROM positions p LEFT JOIN message_log m
          ON p.chat_id = m.chat_id AND p."partition" = m."partition" AND m."offset" >= p."offset"
        GROUP BY ALL""",
    "unread_chats": """
        SELECT user_id, chat_id, CAST(sum(unread) AS BIGINT) AS unread, max(newest_ms) AS newest_ms
        FROM unread_parts GROUP BY ALL""",
    "sessions": f"""
        SELECT CAST(event_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id,
               {ms('ts')} + 900000 AS validity_time
        FROM events""",
    "invitations": """
        SELECT CAST(l_suppkey AS VARCHAR) AS user_id, l_orderkey * 10 + l_linenumber AS "offset",
               'chat--' || l_partkey AS chat_id, 'Part ' || l_partkey || ' ' || l_returnflag AS chat_name,
               'Supplier#' || lpad(CAST(l_linenumber AS VARCHAR), 9, '0') AS login
        FROM lineitem""",
    "offset_updates": f"""
        SELECT CAST(l_suppkey AS VARCHAR) AS user_id, 'chat--' || l_orderkey AS chat_id,
               {ms('l_shipdate')} AS last_message_time,
               CAST(trunc(l_quantity) AS BIGINT) % 7 AS o0, CAST(round(l_discount * 100) AS BIGINT) AS o1,
               l_partkey % 5 AS o2, l_linenumber, l_partkey, l_extendedprice
        FROM lineitem""",
    "shipment_edges": """
        SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation FROM lineitem""",
    "graph_vertices": """
        SELECT user_num_id AS id, login AS name FROM users
        UNION ALL
        SELECT id, 'John Doe' FROM (SELECT src AS id FROM shipment_edges UNION SELECT dst FROM shipment_edges)
        WHERE id NOT IN (SELECT user_num_id FROM users)""",
    "members": """
        SELECT DISTINCT uc.chat_id, u.user_num_id AS id FROM users_chats uc JOIN users u ON u.user_id = uc.user_id""",
    "edges": """
        SELECT a.id AS src, b.id AS dst FROM members a JOIN members b ON a.chat_id = b.chat_id AND a.id < b.id""",
    "direct_chats": """
        SELECT DISTINCT CASE WHEN l_linenumber % 2 = 1
                 THEN 'chat--' || l_suppkey || '--' || (l_partkey + 1000000)
                 ELSE 'chat--' || (l_partkey + 1000000) || '--' || l_suppkey END AS chat_id
        FROM lineitem""",
    "direct_pairs": """
        SELECT chat_id, least(split_part(chat_id, '--', 2), split_part(chat_id, '--', 3)) AS first_user,
               greatest(split_part(chat_id, '--', 2), split_part(chat_id, '--', 3)) AS second_user
        FROM direct_chats""",
    "wanted_logins": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'Supplier#' || substr(c_name, 10, 9) AS login FROM customer""",
    "typed_names": """
        SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT CAST(p_size AS VARCHAR) FROM part
        UNION SELECT c_name FROM customer UNION SELECT c_mktsegment FROM customer""",
    "profile": """
        SELECT u.user_id, u.login, s.joining_offset, s.session_duration, s.zone_id
        FROM users u JOIN settings s ON u.user_id = s.user_id""",
    "search_hits": """
        SELECT pattern, user_id, login
        FROM users, (VALUES ('supplier#0+1'), ('[1-3]0$'), ('99')) p(pattern)
        WHERE regexp_matches(login, '(?i)' || pattern)""",
    "tokens": f"""
        SELECT session_id, {uuid_of('session_id')} AS sid, {uuid_of('user_id')} AS uid, validity_time,
               CAST(session_id AS BIGINT) % 5 AS shape, user_id AS plain
        FROM sessions""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the views it uses, directly or through others."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql):
                add(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    if not needed:
        return body
    recursive = "RECURSIVE " if "WITH_RECURSIVE" in body else ""
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    more = body.replace("WITH_RECURSIVE", ",", 1) if recursive else body
    return f"WITH {recursive}{views}\n{more}"
