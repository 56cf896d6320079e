"""Relational tables: users, chats, memberships, sessions, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A table read in ``partitions`` range queries; filters and columns reach the database."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, with zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(path)
    return df.select(
        *[
            F.col(field.name).cast("timestamp").alias(field.name)
            if isinstance(field.dataType, T.TimestampNTZType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )
