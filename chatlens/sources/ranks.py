"""Ranks of users as a stored table that every run replaces as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.streaming.versions import VersionedTable

KEY, RANK = "user_num_id", "page_rank"


class RankTable:
    """user_num_id and page_rank of the last run that ended; readers see one run or the next, never a mixture."""

    def __init__(self, spark: SparkSession, path: str):
        schema = spark.createDataFrame([], f"{KEY} long, {RANK} double").schema
        self.table = VersionedTable(spark, path, schema, [KEY])

    def save(self, ranks: DataFrame) -> None:
        """Ranks (``graph.page_ranks``) in place of those of the run before. Users without a number are left out."""
        rows = ranks.filter(F.col(KEY).isNotNull()).select(F.col(KEY).cast("long").alias(KEY), F.col(RANK).cast("double").alias(RANK))
        self.table.replace(rows)

    def ranks(self) -> DataFrame:
        return self.table.state()

    def of(self, users: DataFrame) -> DataFrame:
        """``users`` (user_num_id and more) with their saved page_rank, null where the run did not know them."""
        return users.drop(RANK).join(self.ranks(), KEY, "left")
