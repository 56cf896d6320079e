"""Operator 11: secrets in texts.

Three patterns with fixed forms find assignments, access keys and long hexadecimal strings. Strings of no known form are
found by how badly a vocabulary of common text compresses them: written words take three to five
characters a token, random strings fewer than two. Known digests and identifiers are left alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of the base, in order, and what a match needs.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = r"[A-Za-z0-9+/_.=-]+"
KINDS = ["assign", "access", "hex"]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

RANDOM = "random"
VOCABULARY = "byte_bpe_50k.tiktoken"
# A run of these characters is judged from LEAST_RUN on; fewer characters a token than RATIO are random. Of
# random strings over 36, 62 or 64 characters, 97 % and more are below it; words of four languages are not.
RUN = r"[A-Za-z0-9+/_=-]"
LEAST_RUN = 16
RATIO = 1.9
# Longer runs are judged in stretches, so a vocabulary never sees a long one whole.
STRETCH = 64
REMEMBERED = 100_000

# Lengths of hexadecimal digests (128 to 512 bits) and the forms of other known identifiers.
_DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|sha(?:256|384|512)-[A-Za-z0-9+/]{43,86}={0,2})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_LETTER = re.compile(r"[A-Za-z]")
_JOINT = re.compile(r"[+/_=-]+")
_PLAIN = re.compile(r"[0-9]{0,11}|[A-Z]?[a-z]{0,11}|[A-Z]{1,11}")


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


def _base_patterns() -> list:
    """(kind, pattern, group that is measured, its least length)."""
    names = "|".join(_either_case(name) for name in NAMES)
    assign = re.compile(rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?({VALUE})")
    return [
        ("assign", assign, 1, LEAST_VALUE),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, LEAST_ACCESS),
        # Runs that are too short need not be looked at.
        ("hex", re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}"), 0, LEAST_HEX),
    ]


def base_spans(text: str, patterns: list | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(patterns or _base_patterns()):
        for match in pattern.finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), order, match.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def is_known(run: str) -> bool:
    """Whether a run is a digest, a number or an identifier made of short words and numbers."""
    if not _LETTER.search(run) or _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    parts = _JOINT.split(run)
    return len(parts) > 1 and all(_PLAIN.fullmatch(part) for part in parts)


def stretches(length: int) -> list[tuple[int, int]]:
    """A run as stretches of STRETCH characters, the last one up to twice as long."""
    cuts = [0, *range(STRETCH, length - STRETCH + 1, STRETCH), length]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def random_spans(text: str, tokens, run: re.Pattern, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of stretches with fewer than ``ratio`` characters a token; ``tokens`` counts them."""
    found: list[tuple[int, int]] = []
    for match in run.finditer(text):
        own, begin = match.group(), match.start()
        if is_known(own):
            continue
        joined = False
        for low, high in stretches(len(own)):
            hit = high - low < ratio * tokens(own[low:high])
            if hit and joined:
                found[-1] = (found[-1][0], begin + high)
            elif hit:
                found.append((begin + low, begin + high))
            joined = hit
    return found


def _token_counter(path: str):
    """Number of tokens of a string, by a vocabulary of ranks; the latest answers are kept."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def tokens(text: str) -> int:
        if text not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[text] = len(coder.encode_ordinary(text))
        return known[text]

    return tokens


def _finder(vocabulary: str, ratio: float, least_run: int):
    """All spans of a text, base kinds and random runs that no base span covers."""
    import os

    import public_tokenizers

    tokens = _token_counter(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
    patterns, run = _base_patterns(), re.compile(rf"(?<!{RUN}){RUN}{{{least_run},}}")

    def find(text: str) -> list[tuple[int, int, str]]:
        spans = base_spans(text, patterns)
        more = random_spans(text, tokens, run, ratio)
        if not more:
            return spans
        # The widest base span so far tells whether a later start is covered.
        merged, reach, at = [], 0, 0
        for low, high in more:
            while at < len(spans) and spans[at][0] <= low:
                merged.append(spans[at])
                reach = max(reach, spans[at][1])
                at += 1
            if reach < high:
                merged.append((low, high, RANDOM))
        return merged + spans[at:]

    return find


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def secret_spans(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO, least_run: int = LEAST_RUN) -> DataFrame:
    """``docs`` with ``spans``: kind, start and end (code points, end exclusive) of every secret, by start.

    Works through whole texts. A null text has no spans. A column named spans is replaced; all other columns and rows
    stay, repeated ones too. ``vocabulary`` is a file of the public tokenizers, or a path every executor can open.
    """
    docs = docs.drop("spans")

    def scan(batches):
        find = _finder(vocabulary, ratio, least_run)
        for batch in batches:
            count, kinds, starts, ends = [0], [], [], []
            for text in batch.column("_scanned"):
                for start, end, kind in find(text.as_py() or ""):
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
                count.append(len(kinds))
            each = [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            spans = pa.StructArray.from_arrays(each, ["kind", "start", "end"])
            listed = pa.ListArray.from_arrays(pa.array(count, pa.int32()), spans)
            yield batch.drop_columns(["_scanned"]).append_column("spans", listed)

    schema = docs.withColumn("spans", F.lit(None).cast(_SPANS)).schema
    return docs.withColumn("_scanned", F.col("text").cast("string")).mapInArrow(scan, schema)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of each kind, a digest of the base spans, all spans as text."""
    found = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in [*KINDS, RANDOM]]
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[{kind}]", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; overlapping spans become one, named by the first."""
    names = F.create_map(*[F.lit(x) for kind in [*KINDS, RANDOM] for x in (kind, mask.format(kind=kind))])
    found = secret_spans(docs.withColumn("text", F.col("text").cast("string")), **options)
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("upto"))

    def step(state, s):
        fresh = s["start"] >= state["upto"]
        between = F.substring(F.col("text"), state["upto"] + 1, s["start"] - state["upto"])
        done = F.when(fresh, F.concat(state["done"], between, F.element_at(names, s["kind"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.greatest(state["upto"], s["end"]).alias("upto"))

    def finish(state):
        return F.concat(state["done"], F.substring(F.col("text"), state["upto"] + 1, F.length("text")))

    changed = F.when(F.size("spans") > 0, F.aggregate("spans", begin, step, finish)).otherwise(F.col("text"))
    return found.withColumn("text", changed).select(*docs.columns)
