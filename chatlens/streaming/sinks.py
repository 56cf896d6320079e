"""Where streams end: an output log, CSV files, a table, a versioned table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from chatlens.operators.encode import log_record

BATCH = "batch_id"


def to_log(df: DataFrame, servers: str, topic: str, **options: str) -> DataStreamWriter:
    """Append rows as JSON records to a topic. Needs the Kafka connector."""
    writer = log_record(df).writeStream.outputMode("append").format("kafka")
    return writer.option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options)


def to_keyed_log(df: DataFrame, servers: str, topic: str, mode: str = "update", **options: str) -> DataStreamWriter:
    """Write text pairs (key, value) to a topic, by default one for every change of a result."""
    writer = df.select("key", "value").writeStream.outputMode(mode).format("kafka")
    return writer.option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options)


def to_csv(df: DataFrame, path: str, every: str = "10 seconds") -> DataStreamWriter:
    """Append CSV files with a header, columns parted by ``||``."""
    return (
        df.writeStream.outputMode("append")
        .format("csv")
        .option("header", True)
        .option("sep", "||")
        .option("path", path)
        .trigger(processingTime=every)
    )


def _each_batch(df: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return df.writeStream.outputMode(mode).foreachBatch(write)


def to_table(df: DataFrame, path: str, mode: str = "append") -> DataStreamWriter:
    """Add rows to a parquet table, created on first use.

    A batch owns its folder, so a batch repeated after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return _each_batch(df, mode, write)


def to_versions(df: DataFrame, path: str) -> DataStreamWriter:
    """Keep every change of an updating result; ``latest_rows`` reads the current state."""
    return to_table(df, path, mode="update")


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last version of each row of a versioned table."""
    versions = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path)
    values = [name for name in schema.fieldNames() if name not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_last"))
    return last.select(*[F.col(name) if name in keys else F.col(f"_last.{name}").alias(name) for name in schema.fieldNames()])


def to_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "append") -> DataStreamWriter:
    """Insert rows into a database table, created on first use.

    Rows carry their batch id; a unique key over it and the row's own key keeps a repeated
    batch from being stored twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(BATCH, F.lit(batch_id)).write.mode("append").jdbc(url, table, properties=properties)

    return _each_batch(df, mode, write)
