"""Operator 5: shards of equal row counts along a Hilbert curve over metadata.

Every dimension is quantised to a few bits, rows are ordered by their cell's place on the Hilbert
curve, and the order is cut into runs. Files written from the runs have narrow ranges in all
dimensions at once, so filters on any of them skip files. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import table

BITS = 4
SHARDS = 8
# Rows of a cell numbered in one task.
RUN = 100_000


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates below 2 ** bits.

    The coordinates are turned step by step, from the highest bit down, as one fold over the list of
    (bit, dimension); then Gray-coded and their bits interleaved.
    """
    n = len(coordinates)
    steps = F.array(*[
        F.struct(F.lit(1 << bit).alias("q"), F.lit(at).alias("at")) for bit in range(bits - 1, 0, -1) for at in range(n)
    ]) if bits > 1 else F.array().cast("array<struct<q:int,at:int>>")

    def turn(x: Column, step: Column) -> Column:
        q, at = step["q"], step["at"]
        own, first = F.get(x, at), F.get(x, 0)
        low = q - 1
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        flip = own.bitwiseAND(q) != 0
        new_first = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, i: F.when(i == 0, new_first).when(i == at, new_own).otherwise(v))

    start = F.array(*[c.cast("int") for c in coordinates])
    turned = F.aggregate(steps, start, turn)
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)), turned,
        lambda x, at: F.transform(x, lambda v, i: F.when(i == at, v.bitwiseXOR(F.get(x, at - 1))).otherwise(v)),
    ) if n > 1 else turned
    powers = F.array(*[F.lit(1 << bit) for bit in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")

    def place(x: Column) -> Column:
        last = F.get(x, n - 1)
        flips = F.aggregate(powers, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        spots = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(at).alias("at")) for bit in range(bits - 1, -1, -1) for at in range(n)])
        settled = F.transform(x, lambda v: v.bitwiseXOR(flips))
        return F.aggregate(
            spots, F.lit(0).cast("long"),
            lambda h, s: h * 2 + F.call_function("shiftright", F.get(settled, s["at"]), s["bit"]).bitwiseAND(1),
        )

    # A list of one element binds the fold's result to a name, so it is written once in the plan.
    return F.get(F.transform(F.array(gray), place), 0)


def _steps(df: DataFrame, numbers: list[str], bits: int) -> dict[str, list[float]]:
    """Bounds that cut each number into 2 ** bits parts of about equal counts."""
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(F.col(name).cast("double"), share, 10_000).alias(name) for name in numbers]).first()
    return {name: row[name] or [] for name in numbers}


def hilbert_shards(
    rows: DataFrame, numbers: list[str], names: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS, run: int = RUN
) -> DataFrame:
    """``rows`` with hilbert, shard and slot: runs along the curve, counts at most one apart.

    ``numbers`` are cut at quantiles, ``names`` (texts) hashed; null is the lowest part of a number
    and a text of its own. ``tie`` orders rows within a cell, after a hash of its first column;
    rows equal in all of ``tie`` are interchangeable. Slots count from 0 without gaps. Columns of ``rows``
    with the names of new ones are replaced.
    """
    rows = rows.drop("hilbert", "shard", "slot")
    cuts = _steps(rows, numbers, bits)
    coordinate = {
        name: sum([(F.coalesce(F.col(name).cast("double"), F.lit(float("-inf"))) >= F.lit(float(cut))).cast("int") for cut in cuts[name]], F.lit(0))
        for name in numbers
    } | {name: F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("int") for name in names}
    axes = [f"_hs_c{at}" for at in range(len(coordinate))]
    placed = table(rows.select("*", *[c.alias(axis) for c, axis in zip(coordinate.values(), axes, strict=True)]), "placed")
    # One row per cell that has rows, 2 ** (bits * dimensions) at most.
    cells = placed.groupBy(*axes).agg(F.count(F.lit(1)).alias("_hs_n"))
    cells = table(cells.withColumn("hilbert", hilbert_index([F.col(axis) for axis in axes], bits)), "cells")
    total = cells.agg(F.sum("_hs_n")).first()[0] or 0
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*axes, "hilbert", F.ceil(F.col("_hs_n") / run).cast("int").alias("_hs_parts"),
                         F.coalesce(F.sum("_hs_n").over(along), F.lit(0)).alias("_hs_before"))
    located = placed.join(cells, axes)
    # Cells above ``run`` rows are numbered in parts, so a cell of any size is spread over tasks.
    located = located.withColumn("_hs_part", F.pmod(F.xxhash64(tie[0]), F.col("_hs_parts")).cast("int"))
    parts = located.groupBy("hilbert", "_hs_part").agg(F.count(F.lit(1)).alias("_hs_m"))
    inside = Window.partitionBy("hilbert").orderBy("_hs_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("hilbert", "_hs_part", F.coalesce(F.sum("_hs_m").over(inside), F.lit(0)).alias("_hs_ahead"))
    order = Window.partitionBy("hilbert", "_hs_part").orderBy(*tie)
    numbered = located.withColumn("_hs_row", F.row_number().over(order)).join(parts, ["hilbert", "_hs_part"])
    rank = (F.col("_hs_before") + F.col("_hs_ahead") + F.col("_hs_row") - 1).cast("long")
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)
    at = F.col("_hs_rank")
    size = max(small, 1)
    late = F.expr(f"cast((_hs_rank - {edge}L) div {size}L as int)") + larger
    shard = F.when(at < edge, F.expr(f"cast(_hs_rank div {small + 1}L as int)")).otherwise(late)
    start = F.when(F.col("shard") <= larger, F.col("shard") * F.lit(small + 1)).otherwise(
        F.lit(edge) + (F.col("shard") - larger) * F.lit(small)
    )
    return (
        numbered.withColumn("_hs_rank", rank).withColumn("shard", shard.cast("int"))
        .withColumn("slot", (at - start).cast("long")).select(*rows.columns, "hilbert", "shard", "slot")
    )


def document_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, run: int = RUN) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null).

    A null text has size 1 and the checksum of no bytes, 0. Every row counts, also with a null or
    repeated doc_id. Fewer rows than shards leave the last shards empty.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), "lang", "source",
    )
    found = hilbert_shards(rows, ["size", "doc_id"], ["lang", "source"], ["doc_id", "size", "text_crc32"], shards, bits, run)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """``docs`` (doc_id, text, lang, source, ...) as files, one folder for each shard, in curve order."""
    text = F.col("text").cast("string")
    sized = docs.withColumn("_hs_size", F.coalesce(F.octet_length(text), F.lit(0)) + 1).withColumn("_hs_crc", F.crc32(F.coalesce(text, F.lit(""))))
    found = hilbert_shards(sized, ["_hs_size", "doc_id"], ["lang", "source"], ["doc_id", "_hs_size", "_hs_crc"], shards, bits)
    ready = found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("_hs_size", "_hs_crc", "hilbert", "slot")
    ready.write.mode("overwrite").partitionBy("shard").parquet(path)
