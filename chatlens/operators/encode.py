"""Result rows as records of an output log: a null key and a JSON value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions import instant_text, rounded_ms
from chatlens.functions.scalars import UUID_TEXT, known_zone


def log_record(df: DataFrame, *columns: str) -> DataFrame:
    """Pack ``columns`` (all by default) into the binary value of an output record."""
    packed = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.lit(None).cast("binary").alias("key"), packed.cast("binary").alias("value"))


def delay_result(df: DataFrame, group: str | None = None, uuid_group: bool = False) -> DataFrame:
    """A delay row with the average in whole milliseconds and the bounds as text instants.

    With ``uuid_group`` a group value that is no UUID fails the job: the record type has no
    place for it, and a dropped row would go unnoticed.
    """
    key = []
    if group:
        checked = F.when(
            F.col(group).rlike(rf"\A{UUID_TEXT}\z"), F.col(group)
        ).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), F.coalesce(F.col(group), F.lit("null")))))
        key = [(checked if uuid_group else F.col(group)).alias(group)]
    return df.select(
        instant_text("window_start").alias("window_start"),
        instant_text("window_end").alias("window_end"),
        *key,
        rounded_ms("avg_diff_time_ms").alias("delay_ms"),
    )


def encode_delay(df: DataFrame, group: str | None = None, uuid_group: bool = False) -> DataFrame:
    return log_record(delay_result(df, group, uuid_group))


def checked_results(df: DataFrame, group: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose group is well formed, rows to be looked at): no row is lost, and none stops a stream.

    ``kind`` is "uuid" or "zone".
    """
    fine = F.col(group).rlike(rf"\A{UUID_TEXT}\z") if kind == "uuid" else known_zone(group).isNotNull()
    fine = F.coalesce(fine, F.lit(False))
    return df.filter(fine), df.filter(~fine)
