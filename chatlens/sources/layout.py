"""A chat log laid out for cursors: cells of consecutive offsets, bucketed and sorted.

A cell is a run of ``per_cell`` offsets of one partition. Records are bucketed by (chat_id, partition, cell)
and sorted by offset inside, so whatever meets them by cell needs no shuffle of the log, and a busy chat
lies in all buckets. Beside the records a summary keeps one row per cell and addition; totals over many cells read
it instead of the records.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.plans import discard, materialize, met, scratch_path, shuffles_removed
from chatlens.sources.cells import CELLS_PER_BLOCK, Directory, block_of

PER_CELL = 256
CELL = "cell"
KEYS = ["chat_id", "partition", CELL]


def cell_of(offset: Column | str, per_cell: int) -> Column:
    return F.floor((F.col(offset) if isinstance(offset, str) else offset) / F.lit(per_cell))


def summary_of(records: DataFrame) -> DataFrame:
    """(chat_id, partition, cell, records, last_offset, newest_ms)."""
    return records.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("records"),
        F.max("offset").alias("last_offset"),
        F.max(F.unix_millis("server_time")).alias("newest_ms"),
    )


class LaidOutLog:
    """Records with their cell, and the summary of all cells. The operators on cursors take it in place of a log."""

    def __init__(self, name: str, path: str, records: DataFrame, cells: DataFrame, buckets: int, per_cell: int):
        self.name, self.path, self.buckets, self.per_cell = name, path, buckets, per_cell
        self.in_cells, self.cells = records, cells

    @property
    def records(self) -> DataFrame:
        """The log as it was."""
        return self.in_cells.drop(CELL)

    def unread_ranges(self, positions: DataFrame, offset_columns: Sequence[str] | None = None) -> DataFrame:
        """Per cursor of ``positions``: unread records, last offset and latest time of its partition.

        Cells count by their summary, but for the one a cursor stands inside of: its records are read, once for all
        cursors at that place. Positions may be wide, as for ``cursors.unread_ranges``.
        """
        record = ["chat_id", "partition", "offset"]
        spark = positions.sparkSession
        cells = self.cells.withColumn("_block", block_of(CELL, CELLS_PER_BLOCK)).repartition("chat_id", "_block")
        cells = cells.groupBy("chat_id", "_block", "partition", CELL).agg(
            F.sum("records").alias("n"), F.max("last_offset").alias("last"), F.max("newest_ms").alias("newest")
        )
        directory = Directory(cells, self.per_cell, CELLS_PER_BLOCK)
        found = directory.meet(positions, offset_columns)
        others = [name for name in positions.columns if name not in [*record, *(offset_columns or [])]]
        found = found.withColumn("_ahead", directory.ahead()).select(*record, *others, "_ahead.*", directory.inside().alias("_inside"))
        # Read three times below, so it is written once.
        found = materialize(found, scratch_path(spark, "places"))
        inside = found.filter("_inside").drop("_inside").withColumn(CELL, cell_of("offset", self.per_cell))
        places = inside.select(*KEYS, "offset").distinct()
        held = self.in_cells.select(*KEYS, F.col("offset").alias("_at"), F.unix_millis("server_time").alias("_ms"))
        held = held.withColumnsRenamed({name: f"_{name}" for name in KEYS})
        together = [F.col(name) == F.col(f"_{name}") for name in KEYS]
        near = places.hint("merge").join(held, [*together, F.col("_at") >= F.col("offset")])
        near = near.groupBy(*KEYS, "offset").agg(
            F.count("_at").alias("_n"), F.max("_at").alias("_last"), F.max("_ms").alias("_newest")
        )
        seen = met(inside, near, [*KEYS, "offset"]).select(
            *record, *others, (F.col("n") + F.col("_n")).alias("n"), F.greatest("last", "_last").alias("last"), F.greatest("newest", "_newest").alias("newest")
        )
        return found.filter("not _inside").drop("_inside").unionByName(seen).withColumnsRenamed(
            {"n": "unread", "last": "last_offset", "newest": "newest_ms"}
        )

    def ends(self) -> DataFrame:
        """(chat_id, partition, last_offset) without a look at the records."""
        return self.cells.groupBy("chat_id", "partition").agg(F.max("last_offset").alias("last_offset"))

    def remove(self, spark: SparkSession) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(spark, self.path)


def _register(spark: SparkSession, records_path: str, schema: str, buckets: int) -> str:
    """Tell the session how the files at a path are bucketed; any session can open a layout this way."""
    name = f"log_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) "
        f"SORTED BY ({', '.join(KEYS)}, offset) INTO {buckets} BUCKETS LOCATION '{records_path}'"
    )
    return name


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema.fields)


def open_layout(spark: SparkSession, path: str, schema: str, buckets: int, per_cell: int = PER_CELL) -> LaidOutLog:
    """A layout written before; ``schema`` lists the columns of the records and the cell."""
    name = _register(spark, f"{path}/records", schema, buckets)
    # Every addition wrote a summary of its own, so a cell may have several rows; all uses add them up.
    return LaidOutLog(name, path, spark.table(name), spark.read.parquet(f"{path}/cells"), buckets, per_cell)


def add_records(log: DataFrame, path: str, buckets: int, per_cell: int = PER_CELL, mode: str = "append") -> str:
    """Write records into a layout, one sorted file a bucket; gives their columns for ``open_layout``."""
    spark = log.sparkSession
    celled = log.withColumn(CELL, cell_of("offset", per_cell))
    schema = _fields(celled)
    name = _register(spark, f"{path}/records", schema, buckets)
    dealt = celled.repartition(buckets, *KEYS)
    with shuffles_removed(spark):
        dealt.write.mode(mode).format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS, "offset").option("path", f"{path}/records").saveAsTable(name)
        files = spark.table(name) if mode == "overwrite" else celled
        summary_of(files).write.mode(mode).parquet(f"{path}/cells")
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return schema


def lay_out(log: DataFrame, path: str | None = None, buckets: int | None = None, per_cell: int = PER_CELL) -> LaidOutLog:
    """Write ``log`` (chat_id, partition, offset, server_time, ...) as a layout at ``path``.

    By default the layout goes to the shared folder, with as many buckets as a shuffle has partitions; give
    more where a bucket would hold more than a task can sort.
    """
    spark = log.sparkSession
    path = path or scratch_path(spark, "log")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = add_records(log, path, buckets, per_cell, "overwrite")
    return open_layout(spark, path, schema, buckets, per_cell)
