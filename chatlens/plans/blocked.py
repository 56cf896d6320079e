"""Running totals and row numbers that no single group can bring down.

A window partitioned by one chat or one user puts that whole group into one task. Here groups
are cut into blocks that follow the sort order, by a number in the order itself or, where it has
none, by range partitioning. Each block is scanned on its own, the blocks of a group are chained through one
summary row per block, and the two parts are combined. The result equals the plain window; the
largest unit of work is one block. All groups are treated alike, whatever their size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.plans.lineage import materialize, materialize_dealt, scratch_path

# kind -> (aggregate of rows, aggregate of block summaries, how two parts combine)
_KINDS = {
    "count": (F.count, F.sum, lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "sum": (F.sum, F.sum, lambda carried, own: F.coalesce(carried + own, carried, own)),
    "max": (F.max, F.max, lambda carried, own: F.greatest(carried, own)),
    "min": (F.min, F.min, lambda carried, own: F.least(carried, own)),
}


def digest(*columns: Column | str) -> Column:
    """A number to sort and meet by before the columns themselves. Sorts compare eight bytes first, and names that begin
    alike tie there; equal digests are told apart by the columns, so results do not depend on it."""
    return F.hash(*columns)


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)``, inner or left, as a sort-merge join by the digest of the keys first."""
    copies = {name: f"_other_{name}" for name in keys}
    equal = [F.col(name) == F.col(copy) for name, copy in copies.items()]
    joined = left.hint("merge").join(
        right.withColumnsRenamed(copies), [digest(*copies) == digest(*copies.values()), *equal], how
    )
    return joined.select(*keys, *[name for name in left.columns if name not in keys], *[name for name in right.columns if name not in keys])


def _all_equal(left: Sequence[str], right: Sequence[str]) -> Column:
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]
    return reduce(lambda one, other: one & other, pairs)


def _in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], pieces: int | None) -> DataFrame:
    keys = [*group, *order]
    dealt = df.repartitionByRange(pieces, *keys) if pieces else df.repartitionByRange(*keys)
    return dealt.withColumn("_block", F.spark_partition_id().cast("long"))


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], pieces: int | None = None) -> DataFrame:
    """``df`` as a table with ``_block``, the piece of a range partitioning by group and order.

    Bounds come from the data, so a large group is spread over many pieces whatever its keys look
    like, and a piece holds a bounded share of the rows. ``pieces`` is the number of pieces, by default
    what adaptive execution makes of the shuffle. The table is written once to the shared folder, so
    everything that reads it sees the same blocks.
    """
    return materialize(_in_ranges(df, group, order, pieces), scratch_path(df.sparkSession, "ranged"))


def _carried(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[Sequence[str]],
    aggs: Mapping[str, tuple[str, str]],
    descending: bool,
    final: int | None = None,
) -> DataFrame:
    """Per block, what all earlier blocks of its group add up to.

    Rows of the block numbered ``final`` feed no other block, so only the rows before it are added up.
    """
    *outer, last = levels
    above = [*group, *[name for level in outer for name in level]]
    keys = [*above, *last]
    direction = F.desc if descending else F.asc
    chain = Window.partitionBy(*above).orderBy(*[direction(name) for name in last])
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    feeding = df if final is None else df.filter(F.col(last[0]) != F.lit(final))
    blocks = feeding.groupBy(*keys).agg(*[_KINDS[kind][0](column).alias(name) for name, (kind, column) in aggs.items()])
    if final is not None:
        ends = blocks.select(*above).distinct().withColumn(last[0], F.lit(final).cast("long"))
        blocks = blocks.unionByName(ends, allowMissingColumns=True)
    carried = blocks.select(
        *keys, *[_KINDS[kind][1](name).over(earlier).alias(f"_carried_{name}") for name, (kind, _) in aggs.items()]
    )
    if not outer:
        return carried
    copies = [f"_above_{name}" for name in above]
    further = _carried(df, group, outer, aggs, descending).select(
        *[F.col(name).alias(copy) for name, copy in zip(above, copies, strict=True)],
        *[F.col(f"_carried_{name}").alias(f"_further_{name}") for name in aggs],
    )
    return carried.join(further, _all_equal(above, copies), "left").select(
        *keys,
        *[
            _KINDS[kind][2](F.col(f"_further_{name}"), F.col(f"_carried_{name}")).alias(f"_carried_{name}")
            for name, (kind, _) in aggs.items()
        ],
    )


def with_running(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[Sequence[str]],
    order: Sequence[Column | str],
    aggs: Mapping[str, tuple[str, str]],
    descending: bool = False,
    final: int | None = None,
) -> DataFrame:
    """Add, per row, aggregates over the row and all rows of its group before it.

    ``levels`` name the block columns, coarse to fine; they follow the order, so a smaller
    block holds only earlier rows, and have no nulls. Blocks of a level are chained inside a block of
    the level above. ``order`` sorts inside the finest block.
    ``aggs`` maps a new column to (kind, input column) with kind one of count, sum, max, min.
    ``descending`` reverses the blocks (the caller gives ``order`` in the wanted direction).
    ``final`` is the number of the block that comes last in every group that has it, for one level of one block
    column; groups that lie in this block alone, most as a rule, then take no part in the chaining.
    """
    keys = [*group, *[name for level in levels for name in level]]
    fed = df.select(
        "*",
        F.lit(1).alias("_turn"),
        *[
            (F.when(F.col(column).isNotNull(), 1).otherwise(0) if kind == "count" else F.col(column)).alias(f"_fed_{name}")
            for name, (kind, column) in aggs.items()
        ],
    )
    # What a block inherits enters as one more row at its head, so rows are shuffled only once. The
    # first block of a group inherits nothing.
    heads = _carried(df, group, levels, aggs, descending, final).select(
        *keys, F.lit(0).alias("_turn"), *[F.col(f"_carried_{name}").alias(f"_fed_{name}") for name in aggs]
    )
    heads = heads.filter(F.coalesce(*[F.col(f"_fed_{name}").cast("string") for name in aggs]).isNotNull())
    inside = (
        Window.partitionBy(digest(*keys), *keys).orderBy("_turn", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = fed.unionByName(heads, allowMissingColumns=True)
    return merged.select(
        "*", *[_KINDS[kind][1](f"_fed_{name}").over(inside).alias(name) for name, (kind, _) in aggs.items()]
    ).filter(F.col("_turn") == 1).select(*df.columns, *aggs)


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str, pieces: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row in its group. ``order`` leaves no ties.

    Rows move once, into their ranges: these are written bucketed by ``_block``, and rows are counted where they lie. Of the
    groups of a range only the first can have begun before it, so there is one row to carry for a block at most, and
    every task gets them all.
    """
    spark = df.sparkSession
    buckets = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocked, _ = materialize_dealt(_in_ranges(df, group, order, pieces), scratch_path(spark, "ranged"), buckets, ["_block"])
    keys = ["_block", *group]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    copies = {key: f"_head_{key}" for key in keys}
    heads = counts.select(*[F.col(key).alias(copy) for key, copy in copies.items()], F.sum("_rows").over(earlier).alias("_before"))
    heads = F.broadcast(heads.filter("_before is not null"))
    inside = blocked.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    position = F.coalesce("_before", F.lit(0)) + F.col("_at")
    return inside.join(heads, _all_equal(list(copies), list(copies.values())), "left").select(*df.columns, position.alias(name))
