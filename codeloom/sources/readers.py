"""Typed readers over a snapshot: by id, name, short name and path, one or many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import simple_name
from codeloom.plans.snapshot import Snapshot


def by_values(s: Snapshot, relation: str, column: str, values: list, *, kind: str = "string") -> DataFrame:
    """Rows of a relation whose column is one of the values: one semi-join, however many there are."""
    wanted = s.spark.createDataFrame([(v,) for v in values], f"{column} {kind}").distinct()
    return s[relation].join(F.broadcast(wanted), column, "left_semi")


def classes_by_ids(s: Snapshot, ids: list[int]) -> DataFrame:
    """Classes by id, current or not."""
    return by_values(s, "classes", "id", ids, kind="long")


def classes_by_names(s: Snapshot, names: list[str]) -> DataFrame:
    """Classes by full name."""
    return by_values(s, "classes", "class_name", names)


def classes_by_short_name(s: Snapshot, name: str) -> DataFrame:
    """Current classes by the part of the name after the last dot."""
    return s.current().where(simple_name(F.col("class_name")) == name)


def classes_by_path(s: Snapshot, path: str) -> DataFrame:
    """Classes of a source file, current or not."""
    return s.classes.where(F.col("source_file") == path)


def module_classpath(visibility: DataFrame, module: str | None = None) -> DataFrame:
    """Visible modules (module, visible, distance) by distance, then name."""
    found = visibility if module is None else visibility.where(F.col("module") == module)
    return found.orderBy("module", "distance", "visible")


def metadata(rows: DataFrame) -> dict[str, str]:
    """A small table of keys and values as a dict."""
    return {r.key: r.value for r in rows.select("key", "value").collect()}


def external_catalogue(parsed: DataFrame) -> DataFrame:
    """(class_name, kind, jar, members) of classes in dependency JARs, as parsed."""
    jar = F.substring_index(F.substring_index("path", "!/", 1), "/", -1)
    return parsed.where("problem is null").select("class_name", "kind", jar.alias("jar"), F.size("members").alias("members"))
