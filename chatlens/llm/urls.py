"""Operator 2: URL rules by a bit-parallel wildcard automaton.

A rule is a host, a path and a verdict; `*` stands for any run of bytes within the host or within the path, and
`?` for one byte. All rules are packed side by side into 64-bit words, one bit per byte of a rule, and
advance together over the canonical URL (Shift-And); many URLs advance at once as rows of an array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
# The rules of the sample query, as (verdict, host, path).
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]
# Stands between host and path; no byte of a UTF-8 text.
_EDGE = 0xFF


@dataclass
class Automaton:
    """Masks of the packed rules: rows of 64-bit words, per byte or for all."""

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: list[tuple[int, int]]
    words: int


def compile_rules(rules: list[tuple[str, str, str]]) -> Automaton:
    """A rule fits its host and all subdomains of it, where the path starts with the rule's path."""
    sizes, parsed = 0, []
    for _, host, path in rules:
        tokens, stars = [], set()
        for byte in b"." + host.encode() + bytes([_EDGE]) + path.encode():
            if byte == 0x2A:
                stars.add(len(tokens) - 1)
            else:
                tokens.append(byte)
        parsed.append((sizes, tokens, stars))
        sizes += len(tokens)
    words = max(1, -(-sizes // 64))
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    first, last = np.zeros(words, np.uint64), []

    def mark(masks: np.ndarray, at: int) -> None:
        masks[..., at // 64] |= np.uint64(1 << (at % 64))

    plain = np.arange(256) != _EDGE
    for base, tokens, stars in parsed:
        mark(first, base)
        for at, byte in enumerate(tokens):
            if byte == 0x3F:
                step[plain, (base + at) // 64] |= np.uint64(1 << ((base + at) % 64))
            else:
                mark(step[byte], base + at)
            if at in stars:
                stay[plain, (base + at) // 64] |= np.uint64(1 << ((base + at) % 64))
        last.append(divmod(base + len(tokens) - 1, 64))
    return Automaton(step, stay, first, last, words)


def fitting(automaton: Automaton, urls: list[bytes], area: int = 1 << 24) -> np.ndarray:
    """Which rule fits which canonical URL: booleans (URLs, rules).

    URLs are taken in the order of length, so an array of bytes of bounded area holds many short ones or one long.
    """
    length = np.array([len(url) for url in urls], np.int64)
    order = np.argsort(length, kind="stable")
    hit = np.zeros((len(urls), automaton.words), np.uint64)
    low = 0
    while low < len(urls):
        high = low + 1
        while high < len(urls) and (high + 1 - low) * length[order[high]] <= area:
            high += 1
        part = order[low:high]
        width = int(length[part[-1]])
        data = np.frombuffer(b"".join(urls[at].ljust(width, b"\0") for at in part), np.uint8).reshape(len(part), width)
        state = np.zeros((len(part), automaton.words), np.uint64)
        seen = np.zeros_like(state)
        for at in range(width):
            begin = np.searchsorted(length[part], at, side="right")
            byte, now = data[begin:, at], state[begin:]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            # A rule may begin anywhere: its first byte is the dot before a label.
            moved = (moved & ~automaton.first) | automaton.first
            state[begin:] = (moved & automaton.step[byte]) | (now & automaton.stay[byte])
            seen[begin:] |= state[begin:]
        hit[part] = seen
        low = high
    if not automaton.last:
        return np.zeros((len(urls), 0), bool)
    return np.stack([(hit[:, word] >> np.uint64(bit)) & np.uint64(1) for word, bit in automaton.last], axis=1).astype(bool)


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), upper, upper.lower())
    return F.when(url.contains("://"), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(url.contains("://"), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = ALLOW) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The longest fitting rule decides, of equally long ones the first; without any, rule is null and the
    verdict is ``default``; so it is for all urls where there are no rules. A null url, or one without `://`, has an empty host and path and fits no rule.
    Every row is judged, also with a null or repeated page_id.
    """
    automaton = compile_rules(rules)
    names = [f"{host}{path}" for _, host, path in rules]
    order = sorted(range(len(rules)), key=lambda at: -len(names[at].encode()))
    verdicts = [verdict for verdict, _, _ in rules]

    def check(batches):
        for batch in batches:
            hosts = batch.column("host").cast(pa.binary()).to_pylist()
            paths = batch.column("path").cast(pa.binary()).to_pylist()
            fits = fitting(automaton, [b"." + h + bytes([_EDGE]) + p for h, p in zip(hosts, paths, strict=True)])
            chosen = np.full(len(hosts), -1)
            for at in order[::-1]:
                chosen[fits[:, at]] = at
            rule = pa.array([names[at] if at >= 0 else None for at in chosen], pa.string())
            verdict = pa.array([verdicts[at] if at >= 0 else default for at in chosen], pa.string())
            yield batch.append_column("rule", rule).append_column("verdict", verdict)

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parts.mapInArrow(check, "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
              WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
