"""A keyed table that a stream updates: one folder per batch, folded into a snapshot from time to time.

The state of the table is the snapshot plus the batches after it, the last version of a key counting. Which snapshot
holds is said by the newest manifest, a small file that appears under its final name in one step: a reader sees the
table before or after a fold, never between. A fold that fails leaves files no manifest names; the next
one removes them. A table has one writer, its stream; any number of readers may look on.

Rows are dealt to ``parts`` by a hash of their key, so a batch looks up, and a fold rewrites, only
the parts with changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from chatlens.plans.lineage import discard, listed, shuffles_removed
from chatlens.plans.manifest import Manifests

BATCH, PART = "batch_id", "part"
PARTS = 16


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], parts: int = PARTS):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path.rstrip("/"), schema, list(keys), parts
        self.values = [name for name in schema.fieldNames() if name not in keys]
        self.manifests = Manifests(spark, self.path)

    # --- what there is ---

    def _manifest(self) -> dict:
        return self.manifests.read() or {"through": -1, PART: {}}

    def folded(self) -> int:
        """The last batch that the snapshot holds, -1 without one."""
        return self._manifest()["through"]

    def batches(self) -> list[int]:
        """Batches whose folder is complete, in order."""
        found = sorted(int(name.split("=")[1]) for name in listed(self.spark, self.path) if name.startswith(f"{BATCH}="))
        return [batch for batch in found if "_SUCCESS" in listed(self.spark, f"{self.path}/{BATCH}={batch}")]

    def part_of(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    # --- reading ---

    def paths(self, before: int | None = None, parts: Sequence[int] | None = None) -> tuple[list[str], list[str]]:
        """Folders of the snapshot and of the batches after it, of some parts or all."""
        manifest = self._manifest()
        wanted = None if parts is None else {str(part) for part in parts}
        snapshot = [
            f"{self.path}/_snapshots/{folder}/{PART}={part}"
            for part, folder in manifest[PART].items()
            if wanted is None or part in wanted
        ]
        tail = []
        for batch in self.batches():
            if batch > manifest["through"] and (before is None or batch < before):
                folder = f"{self.path}/{BATCH}={batch}"
                own = [name for name in listed(self.spark, folder) if name.startswith(f"{PART}=")]
                tail += [f"{folder}/{name}" for name in own if wanted is None or name.split("=")[1] in wanted]
        return snapshot, tail

    def _versions(self, snapshot: list[str], tail: list[str]) -> DataFrame:
        numbered = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        found = self.spark.createDataFrame([], numbered)
        if snapshot:
            found = found.unionByName(self.spark.read.schema(numbered).parquet(*snapshot))
        if tail:
            parted = T.StructType([*numbered.fields, T.StructField(PART, T.IntegerType())])
            read = self.spark.read.schema(parted).option("basePath", self.path).parquet(*tail)
            found = found.unionByName(read.select(*numbered.fieldNames()))
        return found

    def _last(self, versions: DataFrame) -> DataFrame:
        # Few keys have several versions: sorted once, behind the shuffle, instead of on both sides of it.
        last = versions.repartition(*self.keys).groupBy(*self.keys).agg(F.max_by(F.struct(*self.values, BATCH), BATCH).alias("_last"))
        return last.select(*self.keys, "_last.*")

    def state(self, before: int | None = None, parts: Sequence[int] | None = None, of: DataFrame | None = None) -> DataFrame:
        """The last version of each key, of all batches or those ``before`` one; only of the keys in ``of``, if given."""
        versions = self._versions(*self.paths(before, parts))
        if of is not None:
            versions = versions.join(of.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._last(versions).select(*self.schema.fieldNames())

    # --- writing ---

    def write(self, rows: DataFrame, batch: int) -> None:
        """Add a batch. One that is written again replaces itself; one already folded changes nothing."""
        if batch > self.folded():
            dealt = rows.select(*self.schema.fieldNames()).withColumn(PART, self.part_of())
            with shuffles_removed(self.spark):
                dealt.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/{BATCH}={batch}")

    def load(self, rows: DataFrame) -> None:
        """Start a new table with these rows."""
        if self.manifests.names():
            raise ValueError(f"{self.path} already holds a table")
        self._fold(rows.withColumn(BATCH, F.lit(-1).cast("long")), -1, {})

    def replace(self, rows: DataFrame) -> None:
        """These rows in place of all there are, batches included; a reader sees the old ones until all are written."""
        through = max([self.folded(), *self.batches()]) + 1
        self._fold(rows.select(*self.schema.fieldNames()).withColumn(BATCH, F.lit(through).cast("long")), through, {})
        self.clean()

    def _fold(self, rows: DataFrame, through: int, kept: dict) -> None:
        folder = f"s-{through}-{uuid.uuid4().hex}"
        target = f"{self.path}/_snapshots/{folder}"
        # A part is one file while it is small; large ones are cut, so that no task writes a whole part.
        with shuffles_removed(self.spark):
            rows.withColumn(PART, self.part_of()).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(target)
        made = {name.split("=")[1]: folder for name in listed(self.spark, target) if name.startswith(f"{PART}=")}
        self.manifests.publish(through + 1, {"through": through, PART: kept | made})

    def compact(self) -> None:
        """Fold all complete batches into the snapshot, then remove what neither this nor the state before needs."""
        manifest = self._manifest()
        done = [batch for batch in self.batches() if batch > manifest["through"]]
        if not done:
            return
        _, tail = self.paths()
        touched = {path.rsplit("=", 1)[1] for path in tail}
        rows = self._last(self._versions(*self.paths(parts=[int(part) for part in touched])))
        self._fold(rows, done[-1], {part: folder for part, folder in manifest[PART].items() if part not in touched})
        self.clean()

    def clean(self) -> None:
        """Readers of the state before the last fold may still be at work, so its files stay until the next."""
        recent = self.manifests.recent()
        if len(recent) > 1:
            for name in listed(self.spark, self.path):
                if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) <= recent[0]["through"]:
                    discard(self.spark, f"{self.path}/{name}")
        used = {(folder, part) for manifest in recent for part, folder in manifest[PART].items()}
        for folder in listed(self.spark, f"{self.path}/_snapshots"):
            if folder not in {one for one, _ in used}:
                discard(self.spark, f"{self.path}/_snapshots/{folder}")
                continue
            for name in listed(self.spark, f"{self.path}/_snapshots/{folder}"):
                if name.startswith(f"{PART}=") and (folder, name.split("=")[1]) not in used:
                    discard(self.spark, f"{self.path}/_snapshots/{folder}/{name}")


def to_compacted(
    df: DataFrame, path: str, keys: Sequence[str], compact_every: int = 20, parts: int = PARTS, mode: str = "update"
) -> DataStreamWriter:
    """Keep the last version of every row of an updating result, folding every ``compact_every`` batches."""
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        held = VersionedTable(batch.sparkSession, path, schema, keys, parts)
        held.write(batch, batch_id)
        if batch_id % compact_every == compact_every - 1:
            held.compact()

    return df.writeStream.outputMode(mode).foreachBatch(write)


def to_keyed(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    compact_every: int = 20,
    parts: int = PARTS,
) -> DataStreamWriter:
    """Apply a stream of changes to a stored table of ``schema``.

    ``merge(stored, changes)`` gives the changed rows from the stored rows with the keys of a batch and the batch. Only
    the parts of the table that the batch touches are read. The stored rows are those before the batch, so a batch repeated
    after a failure gives the same rows again and replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = VersionedTable(batch.sparkSession, path, schema, keys, parts)
        if batch_id > held.folded():
            touched = [row[0] for row in batch.select(held.part_of()).distinct().collect()]  # at most ``parts``
            stored = held.state(before=batch_id, parts=touched, of=batch)
            held.write(merge(stored, batch), batch_id)
        if batch_id % compact_every == compact_every - 1:
            held.compact()

    return df.writeStream.foreachBatch(write)
