"""One immutable generation of an index: named relations, and writing and reading them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class Snapshot:
    """Relations by name; each is built once and lazily."""

    def __init__(self, spark: SparkSession, build: Callable[[str, Snapshot], DataFrame], names: set[str] | None = None) -> None:
        self.spark, self._build, self._made, self._names = spark, build, {}, names

    def has(self, name: str) -> bool:
        """Whether there is such a relation, where that is known; else yes."""
        return self._names is None or name in self._names

    @classmethod
    def of(cls, spark: SparkSession, relations: dict[str, DataFrame]) -> Snapshot:
        """A snapshot of given DataFrames."""
        return cls(spark, lambda name, _: relations[name], set(relations))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Snapshot:
        """A generation on disk; refuses another schema version."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"schema version {manifest['schema_version']}, not {SCHEMA_VERSION}")
        return cls(spark, lambda name, _: spark.read.parquet(f"{path}/{name}"), set(manifest["relations"]))

    def write(self, path: str, names: list[str]) -> None:
        """Write relations as Parquet; the manifest comes last, so a broken write can't be read."""
        for name in names:
            self[name].write.parquet(f"{path}/{name}")
        self.spark.createDataFrame([(json.dumps({"schema_version": SCHEMA_VERSION, "relations": names}),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._build(name, self)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def current(self) -> DataFrame:
        """Classes of the current graph: neither historical nor left over in an output folder."""
        return self["classes"].where(is_current())


def is_current(prefix: str = "") -> Column:
    """The filter of the current graph over class columns."""
    return (F.col(f"{prefix}lifecycle") == "current") & (F.col(f"{prefix}origin") != "orphan_output")


def is_production(prefix: str = "") -> Column:
    """Not a test; no source set means main."""
    return F.coalesce(F.col(f"{prefix}source_set"), F.lit("main")) != "test"
