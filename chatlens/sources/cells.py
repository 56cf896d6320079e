"""A directory of a chat log by which positions find what lies ahead of them.

A cell is a run of offsets of one partition, a block a run of cells with one number in all partitions of a chat. The
directory has one row per chat and block: its cells, and what each partition holds in later blocks. A
row so has at most the cells of a block for each partition, and the positions of a reader that lie in one block, most as a rule,
meet it together.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.plans import materialize, met, scratch_path

CELLS_PER_BLOCK = 256
_PLACE = ["chat_id", "_block"]
_TOTALS = {"n": F.sum, "last": F.max, "newest": F.max}


def floored(number: Column | str, by: int) -> Column:
    return F.floor((F.col(number) if isinstance(number, str) else number) / F.lit(by))


def block_of(cell: Column | str, cells_per_block: int) -> Column:
    """Offsets below zero, which no broker gives, lie in block 0 too: nothing comes before it. None has no block."""
    block = floored(cell, cells_per_block)
    return F.when(block < 0, F.lit(0).cast("long")).otherwise(block)


def sizes(per_block: int) -> tuple[int, int]:
    """Offsets in a cell and cells in a block, about as many, for blocks of ``per_block`` offsets."""
    per_cell = max(1, isqrt(per_block))
    return per_cell, -(-per_block // per_cell)


def cells_of(log: DataFrame, per_cell: int, cells_per_block: int) -> DataFrame:
    """Per cell of a log (chat_id, _block, partition, cell, n, last, newest) and its ``records``, one entry per offset."""
    found = log.select(
        "chat_id", "partition", F.col("offset").cast("long").alias("at"), F.unix_millis("server_time").alias("ms"),
        block_of(floored("offset", per_cell), cells_per_block).alias("_block"),
    ).filter("chat_id is not null and partition is not null and at is not null")
    # Dealt once, by block; all groups below lie inside one.
    entries = found.repartition(*_PLACE).groupBy(*_PLACE, "partition", "at").agg(F.count(F.lit(1)).alias("n"), F.max("ms").alias("ms"))
    return entries.groupBy(*_PLACE, "partition", floored("at", per_cell).alias("cell")).agg(
        F.sum("n").alias("n"), F.max("at").alias("last"), F.max("ms").alias("newest"),
        F.collect_list(F.struct("at", "n", "ms")).alias("records"),
    )


class Directory:
    """``cells``: rows as ``cells_of`` gives, with or without ``records``. They are gathered once, in the shared folder."""

    def __init__(self, cells: DataFrame, per_cell: int, cells_per_block: int):
        self.per_cell, self.cells_per_block = per_cell, cells_per_block
        self.spark, self.has_records = cells.sparkSession, "records" in cells.columns
        inside = [name for name in cells.columns if name not in _PLACE]
        blocks = cells.groupBy(*_PLACE).agg(F.collect_list(F.struct(*inside)).alias("_cells"))
        self.blocks = materialize(blocks, scratch_path(self.spark, "directory"))
        # Where no chat has a second block, there is nothing to carry.
        self.chained = (self.blocks.agg(F.max("_block")).first()[0] or 0) > 0

    def block_of(self, offset: Column | str) -> Column:
        return block_of(floored(offset, self.per_cell), self.cells_per_block)

    def _later(self, asked: DataFrame) -> DataFrame:
        """(chat_id, _block, _later): per block of the directory or ``asked`` for, what its partitions hold in later blocks."""
        held = self.blocks.filter("_block > 0").select(*_PLACE, F.explode("_cells").alias("_cell"))
        held = held.groupBy(*_PLACE, F.col("_cell.partition").alias("partition")).agg(
            *[of(f"_cell.{name}").alias(name) for name, of in _TOTALS.items()]
        )
        parts = held.select("chat_id", "partition").distinct()
        first = parts.select("chat_id", F.lit(0).cast("long").alias("_block"))
        wanted = asked.select(*_PLACE).unionByName(self.blocks.select(*_PLACE)).filter("_block > 0").unionByName(first).distinct()
        merged = held.unionByName(wanted.join(parts, "chat_id").withColumn("_asked", F.lit(True)), allowMissingColumns=True)
        after = Window.partitionBy("chat_id", "partition").orderBy(F.desc("_block")).rangeBetween(Window.unboundedPreceding, -1)
        carried = merged.select(*_PLACE, "partition", "_asked", *[of(name).over(after).alias(name) for name, of in _TOTALS.items()])
        return carried.filter("_asked and n is not null").groupBy(*_PLACE).agg(
            F.collect_list(F.struct("partition", *_TOTALS)).alias("_later")
        )

    def meet(self, positions: DataFrame, offset_columns: Sequence[str] | None = None) -> DataFrame:
        """``positions`` with the ``_cells`` of their block and what lies ``_later``, null where there is nothing.

        Positions are rows with a partition and an offset, or wide with one of ``offset_columns`` per partition: these travel
        in one row for each block they lie in, and come as rows afterwards.
        """
        if not offset_columns:
            rows = positions.filter("chat_id is not null and partition is not null and offset is not null")
            rows = rows.withColumn("_block", self.block_of("offset"))
        else:
            places = F.array_compact(F.array(*[self.block_of(name) for name in offset_columns]))
            rows = positions.filter("chat_id is not null").select("*", F.explode(F.array_distinct(places)).alias("_block"))
        found = met(rows, self.blocks, _PLACE, "left")
        if self.chained:
            found = met(found, self._later(rows), _PLACE, "left")
        if offset_columns:
            each = [F.struct(F.lit(part).alias("partition"), F.col(name).cast("long").alias("offset")) for part, name in enumerate(offset_columns)]
            own = F.filter(F.array(*each), lambda x: self.block_of(x["offset"]) == F.col("_block"))
            kept = [name for name in found.columns if name not in offset_columns]
            found = found.select(*kept, F.inline(own).alias("partition", "offset"))
        return found

    def ahead(self, partition: str = "partition", offset: str = "offset") -> Column:
        """What positions that met the directory find at or after their offset: a struct of n, last and newest. Without
        ``records`` a cell that begins before the offset and ends after it is left out, see ``inside``."""
        kind = "struct<n: bigint, last: bigint, newest: bigint>"
        none = F.struct(F.lit(0).alias("n"), F.lit(None).alias("last"), F.lit(None).alias("newest")).cast(kind)
        cell = floored(offset, self.per_cell)

        def whole(sums: Column, x: Column) -> Column:
            return plus(sums, x["n"], x["last"], x["newest"])

        def add(sums: Column, x: Column) -> Column:
            mine = x["partition"] == F.col(partition)
            if self.has_records:
                own = x["cell"] == cell
                return F.when(mine & own, since(x["records"], offset, sums)).when(mine & (x["cell"] > cell), whole(sums, x)).otherwise(sums)
            return F.when(mine & (x["cell"] * self.per_cell >= F.col(offset)), whole(sums, x)).otherwise(sums)

        near = F.coalesce(F.aggregate("_cells", none, add), none)
        if not self.chained:
            return near
        more = F.aggregate("_later", near, lambda sums, x: F.when(x["partition"] == F.col(partition), whole(sums, x)).otherwise(sums))
        return F.coalesce(more, near)

    def inside(self, partition: str = "partition", offset: str = "offset") -> Column:
        """Whether a position has records of its own cell on both sides, as far as the summary of the cell tells."""
        cell = floored(offset, self.per_cell)
        held = F.exists("_cells", lambda x: (x["partition"] == F.col(partition)) & (x["cell"] == cell) & (x["last"] >= F.col(offset)))
        return (cell * self.per_cell < F.col(offset)) & F.coalesce(held, F.lit(False))


def plus(sums: Column, n: Column, last: Column, newest: Column) -> Column:
    return F.struct(
        (sums["n"] + n).alias("n"), F.greatest(sums["last"], last).alias("last"), F.greatest(sums["newest"], newest).alias("newest")
    )


def since(records: Column, offset: str, sums: Column) -> Column:
    """``sums`` and the entries of a cell at or after an offset."""
    return F.aggregate(records, sums, lambda s, y: F.when(y["at"] >= F.col(offset), plus(s, y["n"], y["at"], y["ms"])).otherwise(s))
