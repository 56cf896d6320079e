"""Cutting lineage by writing a table to the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession

from chatlens.session import shared_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside remove their shuffle files when they have ended; nothing reads these again, as the table
    written stands for them. Else the files stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, path: str, observation: Observation | None = None, *metrics) -> DataFrame:
    """Write ``df`` once and return the table; ``metrics`` are gathered during the write."""
    observed = df.observe(observation, *metrics) if observation is not None else df
    with shuffles_removed(df.sparkSession):
        observed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_dealt(
    df: DataFrame, path: str, buckets: int, keys: Sequence[str], order: Sequence[str] = (), observation: Observation | None = None, *metrics
) -> tuple[DataFrame, str]:
    """The same, of rows dealt by ``keys`` to so many partitions, as a table in ``order`` inside a bucket: what groups by
    the keys needs no shuffle. Gives the table and its name; ``spark.sql("DROP TABLE ...")`` and ``discard`` remove it."""
    name = f"dealt_{uuid.uuid4().hex}"
    observed = df.observe(observation, *metrics) if observation is not None else df
    dealt = observed.write.format("parquet").bucketBy(buckets, *keys)
    with shuffles_removed(df.sparkSession):
        (dealt.sortBy(*order) if order else dealt).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name), name


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(location)] if system.exists(location) else []


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole under its name, by renaming."""
    paths = spark._jvm.org.apache.hadoop.fs
    folder, name = path.rsplit("/", 1)
    hidden, final = paths.Path(f"{folder}/.{name}-{uuid.uuid4().hex}"), paths.Path(path)
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(hidden, final):
        raise OSError(f"could not publish {path}")
