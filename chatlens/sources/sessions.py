"""Sessions stored by the day they expire, so that a purge drops days instead of reading them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.relational import purge_expired_sessions
from chatlens.plans.lineage import discard, listed
from chatlens.plans.manifest import Manifests

DAY, DAY_MS = "day", 86_400_000


class SessionDays:
    """A table of sessions at ``path``: a manifest names the folders of each day.

    A purge or an addition writes new folders and then one manifest; a failure before that changes nothing.
    Files of the state before stay until the next change, for readers still at work.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.manifests = Manifests(spark, self.path)

    def days(self) -> dict[int, list[str]]:
        """The folders of every day."""
        held = self.manifests.read() or {"days": {}}
        return {int(day): folders for day, folders in held["days"].items()}

    def _read(self, days: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/files/{folder}/{DAY}={day}" for day, folders in days.items() for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def frame(self, since: int | None = None) -> DataFrame:
        """All sessions, or those that are valid at or after ``since``; days before it are not read."""
        days = self.days()
        if since is None:
            return self._read(days)
        kept = {day: folders for day, folders in days.items() if day >= since // DAY_MS}
        return self._read(kept).filter(F.col("validity_time") >= F.lit(since))

    def _write(self, sessions: DataFrame) -> dict[int, list[str]]:
        folder = uuid.uuid4().hex
        target = f"{self.path}/files/{folder}"
        day = F.floor(F.col("validity_time") / F.lit(DAY_MS)).alias(DAY)
        # A day with very many sessions is split over tasks at run time.
        dealt = sessions.select(*self.schema.fieldNames(), day).hint("rebalance", DAY)
        dealt.write.partitionBy(DAY).parquet(target)
        return {int(name.split("=")[1]): [folder] for name in listed(self.spark, target) if name.startswith(f"{DAY}=")}

    def _switch(self, days: dict[int, list[str]]) -> None:
        names = self.manifests.names()
        self.manifests.publish(int(names[-1].split(".")[0]) + 1 if names else 0, {"days": days})
        used = {(folder, int(day)) for held in self.manifests.recent() for day, folders in held["days"].items() for folder in folders}
        for folder in listed(self.spark, f"{self.path}/files"):
            kept = {day for one, day in used if one == folder}
            if not kept:
                discard(self.spark, f"{self.path}/files/{folder}")
                continue
            for name in listed(self.spark, f"{self.path}/files/{folder}"):
                if name.startswith(f"{DAY}=") and int(name.split("=")[1]) not in kept:
                    discard(self.spark, f"{self.path}/files/{folder}/{name}")

    def add(self, sessions: DataFrame) -> None:
        """Store more sessions; those without a time are never valid and not stored."""
        days = self.days()
        for day, folders in self._write(sessions.filter("validity_time IS NOT NULL")).items():
            days[day] = days.get(day, []) + folders
        self._switch(days)

    def purge(self, cutoff: int | DataFrame) -> None:
        """Remove sessions that end before ``cutoff``, one time for all or a (user_id, cutoff) table.

        With one time, days before it are dropped unread and only its own day is rewritten. With a table, days up to its last
        cutoff are, as users without a row keep their sessions. Later days keep their files.
        """
        days = self.days()
        if isinstance(cutoff, int):
            days = {day: folders for day, folders in days.items() if day >= cutoff // DAY_MS}
            last = cutoff // DAY_MS if cutoff % DAY_MS else None
            border = {day: folders for day, folders in days.items() if day == last}
        else:
            latest = cutoff.agg(F.max("cutoff")).first()[0]
            border = {} if latest is None else {day: folders for day, folders in days.items() if day * DAY_MS < latest}
        kept = {day: folders for day, folders in days.items() if day not in border}
        if border:
            kept |= self._write(purge_expired_sessions(self._read(border), cutoff))
        self._switch(kept)
