"""Numbered small files that say which folders make up a table; the newest counts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from chatlens.plans.lineage import discard, listed, publish


class Manifests:
    """Each one appears whole under its number. A table has one writer and any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_manifests"

    def names(self) -> list[str]:
        return sorted(name for name in listed(self.spark, self.path) if name.endswith(".json"))

    def read(self, name: str | None = None) -> dict | None:
        """The content of one, by default of the newest; None where there is none."""
        names = [name] if name else self.names()
        if not names:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0])

    def publish(self, number: int, content: dict) -> None:
        publish(self.spark, f"{self.path}/{number:020d}.json", json.dumps(content))

    def recent(self, count: int = 2) -> list[dict]:
        """The last ``count``, oldest first; those before are removed."""
        names = self.names()
        for name in names[:-count]:
            discard(self.spark, f"{self.path}/{name}")
        return [self.read(name) for name in names[-count:]]
