"""Helpers several operators share: scratch tables, text hashing in numpy, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.plans.lineage import discard, materialize, scratch_path

# Words are the maximal runs outside these characters, in bytes of UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WINDOW = 1 << 18
_powers: dict[str, np.ndarray] = {}


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder that all executors share; lineage ends there."""
    return materialize(df, scratch_path(df.sparkSession, f"llm-{label}"))


def gathered(df: DataFrame, rows: int, each: int = 20_000, least: int = 16) -> DataFrame:
    """``df`` in one partition for about ``each`` of its ``rows``, ``least`` ones or more, but in no more than it has.

    A small table otherwise has a file for each partition of the shuffle before it, and every step that reads it a task for each file.
    """
    return df.coalesce(max(least, -(-rows // each)))


class Scratch:
    """Tables of one operator that nobody reads once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """``rows``: about how many units (documents, say) the table speaks of, where it has a few rows for each."""
        self.paths.append(scratch_path(self.spark, f"llm-{label}"))
        return materialize(df if rows is None else gathered(df, rows), self.paths[-1])

    def drop(self, path: str) -> None:
        discard(self.spark, path)
        self.paths.remove(path)

    def clear(self) -> None:
        for path in list(self.paths):
            self.drop(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, length: int) -> np.ndarray:
    """base ** i for i below ``length``; only the usual window's table is kept."""
    if name not in _powers or len(_powers[name]) < length:
        steps = np.full(max(length, _WINDOW * 2), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if length > _WINDOW * 2:
            return made
        _powers[name] = made
    return _powers[name]


def _window_words(data: np.ndarray, spread: bool) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    inside = np.concatenate([[True], space, [True]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lowered = _LOWER[data] if spread else data
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[lowered] * _power("up", _BASE, len(data))[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def hash_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the number of words of each text.

    Works through windows that end between words, so memory beyond the texts is small.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(text) + 1 for text in texts]) if texts else np.zeros(0, np.int64)
    hashes, places = [], []
    start = 0
    while start < len(data):
        stop = min(start + _WINDOW, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            gap = np.flatnonzero(_SPACE[data[stop : stop + _WINDOW]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + _WINDOW, len(data))
        value, begin = _window_words(data[start:stop], lower)
        hashes.append(value)
        places.append(begin + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(ends, np.concatenate(places), side="right")
    return np.concatenate(hashes), np.bincount(owner, minlength=len(texts)).astype(np.int64)


def word_shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The set of word shingles of each text as sorted distinct hashes.

    Fewer words than ``width`` make one shingle of all of them, no words make none.
    """
    words, counts = hash_words(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(0, np.uint64)
    if len(words) >= width:
        size = len(words) - width + 1
        full = words[:size] * factors[0]
        for at in range(1, width):
            full = full + words[at : at + size] * factors[at]
        full = mix(full)
    found = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low >= width:
            found.append(np.unique(full[low : high - width + 1]))
        elif high > low:
            own = (words[low:high] * factors[: high - low]).sum(dtype=np.uint64)
            found.append(mix(np.array([own + np.uint64(high - low)], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def char_hashes(points: np.ndarray, span: int) -> np.ndarray:
    """Hash of the ``span`` code points from each place on."""
    size = len(points) - span + 1
    factors = mix(np.arange(101, 101 + span, dtype=np.uint64)) | np.uint64(1)
    points = points.astype(np.uint64)
    value, term = points[:size] * factors[0], np.empty(size, np.uint64)
    for at in range(1, span):
        np.multiply(points[at : at + size], factors[at], out=term)
        value += term
    value += np.uint64(span)
    return mix(value)


def char_shingles(lines: list[str], width: int) -> list[np.ndarray]:
    """The set of shingles of ``width`` characters of each line, as sorted distinct hashes; a shorter line is one shingle."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = char_hashes(points, width) if len(points) >= width else np.zeros(0, np.uint64)
    sets, start = [], 0
    for line in lines:
        stop = start + len(line)
        if stop - start >= width:
            own = np.sort(hashes[start : stop - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(char_hashes(points[start:stop], stop - start) if stop > start else np.zeros(0, np.uint64))
        start = stop
    return sets


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def slices(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, one text at least."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > limit:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow lists of 64-bit integers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each run of equal ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).to_pylist()
        cuts = [0, *[i for i in range(1, len(codes)) if codes[i] != codes[i - 1]], len(codes)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if held and codes[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = codes[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def keep_marked(df: DataFrame, column: str, marks: DataFrame, bits: int = 24) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the same column of ``marks``.

    The marks become a bitmap of fixed size (2 MB), so it can go to every task whatever the
    input; a semi-join after it removes rows let through by chance.
    """
    spot = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = marks.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).collect()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for row in rows:
        bitmap[row["w"]] = row["m"]
    shared, names = df.sparkSession.sparkContext.broadcast(bitmap), df.columns

    def passing(batches):
        filled = shared.value
        for batch in batches:
            at = batch.column("_spot").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (filled[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select(names)

    return df.withColumn("_spot", spot).mapInArrow(passing, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the first in the order of a hash of the other columns.

    A task passes on one row a value, so a value that many rows have costs one row a task.
    """
    place = fresh(df, "place")
    other = [F.col(f"`{field.name}`") for field in df.schema if field.name not in keys and "map<" not in field.dataType.simpleString()]
    ranked = Window.partitionBy(*[F.col(f"`{key}`") for key in keys]).orderBy(F.xxhash64(*other) if other else F.lit(0))
    return df.withColumn(place, F.row_number().over(ranked)).filter(F.col(place) == 1).drop(place)


def lookup(rows: DataFrame, values: DataFrame, key: str, times: str, spread: list[str], pieces: int = 1000) -> DataFrame:
    """``rows`` with the one row of the table ``values`` for their ``key``; ``times`` there tells how many rows each key has.

    A key with more than 1 / ``pieces`` of the rows is cut into pieces of that size by a hash of the
    columns ``spread``. There are at most ``pieces`` such keys, so their list goes to every task.
    """
    total = values.agg(F.sum(times)).first()[0] or 1
    few = values.withColumn("_pieces", F.ceil(F.col(times) * F.lit(pieces) / F.lit(total)).cast("int")).drop(times)
    hot = F.broadcast(few.filter("_pieces > 1").select(key, "_pieces"))
    dealt = rows.join(hot, key, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int"), F.lit(0)))
    copies = few.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return dealt.drop("_pieces").join(copies.hint("merge"), [key, "_piece"]).drop("_piece")


def components(edges: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Union-find over tables: each round hangs the larger neighbours of every node, and then its
    smaller ones, below the smallest, until nothing moves. Every round is a written table. ``rows``: about how many edges
    there are, if known; the rounds know it from the table before.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()

    def write(df: DataFrame):
        seen, path = Observation(), scratch_path(spark, f"llm-{label}")
        metrics = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        out = materialize(df, path, seen, *metrics)
        got = seen.get
        return out, (got["n"], got["h"]), path

    now, state, path = write(pairs if rows is None else gathered(pairs, rows))
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        after, new_state, new_path = write(gathered(small, state[0]))
        discard(spark, path)
        done = new_state == state
        now, state, path = after, new_state, new_path
        if done:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(column: str) -> Column:
    """True where an array of numbers is present and every component is finite."""
    value = F.col(column)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(value.isNotNull() & ~bad, F.lit(False))



def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, shorter lists filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), counts)
    at = np.arange(len(values)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(column) else row
    out[row, at] = values
    return out


def principal_axes(df: DataFrame, column: str, width: int) -> np.ndarray:
    """Orthonormal directions (as columns) of the vectors in ``column``, most weight first.

    Every task adds up its second moments; their sums are width * width numbers.
    """

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column(0), width)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "value"])

    parts = df.select(column).mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros(width * width)
    for row in parts.collect():
        total[row["at"]] = row["value"]
    total = total.reshape(width, width)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()
