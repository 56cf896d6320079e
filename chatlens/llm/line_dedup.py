"""Operator 9: one line is kept of each group of similar lines, over all documents.

A line's signature is the one-permutation MinHash of its character shingles. Bands of the signature
bring candidates together, exact Jaccard similarity of the shingle sets decides, and union-find over
tables makes the groups. The first line of a group in the order of (doc_id, line number) stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import char_hashes, char_shingles, fresh, lookup, mix, one_of_each, slices, table
from chatlens.llm.setjoin import join_buckets

# Characters of a shingle, similarity in percent, bands of the signature and values in each. A pair
# at the bound shares a band with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997, nearer pairs more often.
WIDTH = 8
PERCENT = 80
BANDS = 8
ROWS = 3
_BITS = 24


def _identities(lines: Iterable[str]) -> np.ndarray:
    """64 bits of a digest of each line; equal for equal lines."""
    digests = [hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest() for line in lines]
    return np.frombuffer(b"".join(digests), "<i8")


def _lines(text: str | None):
    """Number and content of the lines that are not blank."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if line:
            yield number, line


def band_keys(lines: list[str], width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each line, and which lines have them: those shorter than a shingle only resemble equal ones."""
    slots = bands * rows
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.array([len(line) for line in lines], np.int64)
    ends = np.cumsum(count + 1) - 1
    owners = np.repeat(np.arange(len(lines)) * slots, count + 1)
    # Shingles from here on would go beyond their line.
    beyond, outside = (ends[:, None] - np.arange(width)).ravel(), np.zeros(len(points) + 1, bool)
    outside[beyond[beyond >= 0]] = True
    least = np.full(len(lines) * slots, np.iinfo(np.uint64).max, np.uint64)
    step = 1 << 15
    for low in range(0, len(points) - width + 1, step):
        value = char_hashes(points[low : low + step + width - 1], width)
        slot = value >> np.uint64(32)
        slot *= np.uint64(slots)
        slot >>= np.uint64(32)
        value[outside[low : low + len(value)]] = np.iinfo(np.uint64).max
        np.minimum.at(least, owners[low : low + len(value)] + slot.view(np.int64), value)
    found = least.reshape(len(lines), slots)
    full = found != np.iinfo(np.uint64).max
    # An empty slot takes the value of the next one that is filled, marked by the distance.
    for _ in range(slots):
        if full[count >= width].all():
            break
        after = np.roll(found, -1, axis=1) + np.uint64(0x9E3779B97F4A7C15)
        found = np.where(full, found, after)
        full = full | np.roll(full, -1, axis=1)
    keys = np.zeros((len(lines), bands), np.uint64)
    for row in range(rows):
        keys = mix(keys * np.uint64(31) + found.reshape(len(lines), bands, rows)[:, :, row])
    return mix(keys + np.arange(bands, dtype=np.uint64)[None, :]), count >= width


def line_rows(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per line that is not blank: doc_id, digest, line_no, node (its identity), n (characters) and band keys.

    ``docs``: (doc_id, digest, text). Of equal lines in a stretch of texts only the first has band keys.
    """

    def make(batches):
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            owners = batch.select(["doc_id", "digest"])
            for low, high in slices(texts):
                # Per line: its text, its number, and its place among the different lines, which are told by their first place.
                rank: dict[str, int] = {}
                held, numbers, ranks, firsts = [], [], [], []
                for at in range(low, high):
                    for number, line in _lines(texts[at]):
                        place = rank.setdefault(line, len(firsts))
                        if place == len(firsts):
                            firsts.append(len(ranks))
                        held.append(at)
                        numbers.append(number)
                        ranks.append(place)
                if not ranks:
                    continue
                lines, ranks = list(rank), np.array(ranks)
                keys, long = band_keys(lines, width, bands, rows)
                size = np.zeros(len(ranks) + 1, np.int32)
                size[np.array(firsts)[long] + 1] = bands
                offsets = pa.array(np.cumsum(size, dtype=np.int32))
                owner = owners.take(pa.array(held))
                count = np.fromiter(map(len, lines), np.int64, len(lines))
                yield pa.RecordBatch.from_arrays(
                    [
                        *owner.columns,
                        pa.array(numbers, pa.int32()),
                        pa.array(_identities(lines)[ranks]),
                        pa.array(count[ranks]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys[long].view(np.int64).ravel())),
                    ],
                    ["doc_id", "digest", "line_no", "node", "n", "bands"],
                )

    return docs.mapInArrow(make, "doc_id long, digest long, line_no int, node long, n long, bands array<long>")


def _texts_of(docs: DataFrame):
    """(node, text) of the lines whose identity is among given nodes."""

    def texts(nodes: DataFrame) -> DataFrame:
        spot = F.col("node").bitwiseAND((1 << _BITS) - 1)
        words = nodes.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
        bitmap = np.zeros(1 << (_BITS - 6), np.int64)
        # Of fixed size (2 MB); the join below removes what passes by chance.
        for row in words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).collect():
            bitmap[row["w"]] = row["m"]
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)

        def find(batches):
            marked = shared.value
            for batch in batches:
                texts = [text or "" for text in batch.column("text").to_pylist()]
                for low, high in slices(texts):
                    own = list({line: None for text in texts[low:high] for _, line in _lines(text)})
                    nodes = _identities(own)
                    at = nodes & ((1 << _BITS) - 1)
                    hit = np.flatnonzero((marked[at >> 6] >> (at & 63)) & 1)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array([own[i] for i in hit])], schema=find.schema)

        find.schema = pa.schema([("node", pa.int64()), ("text", pa.string())])
        lines = docs.select("text").mapInArrow(find, "node long, text string")
        return lines.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    return texts


def line_classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per line of ``docs`` (doc_id, text) that is not blank: doc_id, line_no, the first line of its
    group as class_doc_id and class_line_no, kept, and digest, which tells texts of one doc_id apart.

    Lines end at line feeds; blanks around a line do not count. Rows without doc_id or text have no
    lines here. Different texts under one doc_id are judged apart; rows equal in both share their fate.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    lines = table(line_rows(docs, width, bands, rows), "lines")
    banded = lines.select("node", "n", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("bucket")
    # Crowded buckets are few beside all band keys, which need no sort to be looked up among them.
    buckets = banded.join(crowded.hint("shuffle_hash"), "bucket", "left_semi").select("bucket", "node", "n").distinct()

    def sets_of(texts: list) -> list:
        return char_shingles(texts, width)

    near = join_buckets(buckets, _texts_of(docs), sets_of, percent)
    # A place is doc_id, 31 bits of line number and 31 bits of the text's digest, in this order.
    low, span = F.lit(1 << 31).cast("decimal(10,0)"), F.lit(1 << 62).cast("decimal(19,0)")
    place = F.col("doc_id").cast("decimal(20,0)") * span + F.col("line_no").cast("decimal(10,0)") * low
    place = (place + F.pmod("digest", F.lit(1 << 31))).cast("decimal(38,0)")
    nodes = table(lines.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "nodes")
    linked = table(nodes.join(near.hint("merge"), "node").select("node", "first", F.col("component").alias("class")), "linked")
    firsts = table(linked.groupBy("class").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("times")), "classes")
    least = lookup(linked.select("node", "class"), firsts, "class", "times", ["node"]).select("node", "least")
    named = nodes.join(least.hint("merge"), "node", "left").select("node", "times", F.coalesce("least", "first").alias("least"))
    found = lookup(lines.select("doc_id", "digest", "line_no", "node"), table(named, "named"), "node", "times", ["doc_id", "digest", "line_no"])
    below = F.pmod("least", span)
    line = ((below - F.pmod(below, low)) / low).cast("int")
    return found.select(
        "doc_id", "line_no", ((F.col("least") - below) / span).cast("long").alias("class_doc_id"),
        line.alias("class_line_no"), (place == F.col("least")).alias("kept"), "digest",
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one line kept of each group of similar lines; all columns stay.

    A document all of whose lines go is left out; blank lines, and documents without any line, stay.
    Of rows equal in doc_id and text one stays; rows without doc_id stay as they are.
    """
    names, schema = docs.columns, docs.schema
    digest, out, owner = fresh(docs, "digest"), fresh(docs, "out"), fresh(docs, "owner")
    gone = line_classes(docs, **options).filter("not kept")
    gone = gone.groupBy(F.col("doc_id").alias(owner), F.col("digest").alias(f"{digest}_of")).agg(F.collect_set("line_no").alias(out))
    known = one_of_each(docs.filter("doc_id is not null").withColumn(digest, F.xxhash64(F.col("text").cast("string"))), ["doc_id", digest])
    same = (F.col("doc_id").cast("long") == F.col(owner)) & (F.col(digest) == F.col(f"{digest}_of"))
    marked = known.join(gone, same, "left")

    def rebuild(batches):
        for batch in batches:
            texts, keep = [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column(out).to_pylist(), strict=True):
                if numbers:
                    dropped = set(numbers)
                    left = [line for number, line in enumerate(text.split("\n")) if number not in dropped]
                    keep.append(any(line.strip() for line in left))
                    text = "\n".join(left)
                else:
                    keep.append(True)
                texts.append(text)
            at = batch.schema.get_field_index("text")
            batch = batch.select(names)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))

    columns = [f"`{name}`" for name in names]
    return marked.select(*columns, out).mapInArrow(rebuild, schema).unionByName(docs.filter("doc_id is null"))
