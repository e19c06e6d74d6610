"""References to configuration keys and resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import escaped_like
from codeloom.plans.snapshot import Snapshot


def matched_keys(s: Snapshot) -> DataFrame:
    """(class_id, kind, key, definition): usages with the definitions they mean: the same key, or for a prefix
    every key below it. Each definition gives all its dotted prefixes, so the join is by equality."""
    parts = F.split("key", r"\.")
    exact = s.configuration_definitions.select("key").distinct()
    below = exact.select("key", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))).alias("n"))
    prefixes = below.select(F.array_join(F.slice(F.split("key", r"\."), 1, F.col("n")), ".").alias("used"), F.col("key").alias("definition"))
    used = s.configuration_usages.select("class_id", "kind", F.col("key").alias("used"))
    same = used.join(exact.select(F.col("key").alias("used"), F.col("key").alias("definition")), "used")
    under = used.where("kind = 'prefix'").join(prefixes, "used")
    return same.unionByName(under).select("class_id", "kind", F.col("used").alias("key"), "definition")


def configuration_references(s: Snapshot, *, pattern: str | None = None) -> DataFrame:
    """Definitions and usages with their state: defined, resolved, unsatisfied or unknown (dynamic)."""
    counts = matched_keys(s).groupBy("class_id", "kind", "key").agg(F.countDistinct("definition").alias("definitions"))
    used = s.configuration_usages.select("class_id", "kind", "key").distinct().join(counts, ["class_id", "kind", "key"], "left")
    state = F.when(F.col("kind") == "dynamic", "unknown").when(F.col("definitions") > 0, "resolved").otherwise("unsatisfied")
    uses = used.select(F.lit("usage").alias("record"), "key", "kind", "class_id", F.coalesce("definitions", F.lit(0)).alias("definitions"), state.alias("status"))
    defs = s.configuration_definitions.select(F.lit("definition").alias("record"), "key", "kind", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("definitions"), F.lit("defined").alias("status"))
    whole = defs.unionByName(uses)
    return whole.where(F.ilike("key", F.lit(escaped_like(pattern)), F.lit("!"))) if pattern else whole


def resource_references(s: Snapshot) -> DataFrame:
    """(class_id, resource_path, resource): usages with the files they mean: the same path, or for a bundle
    its properties file and those of its languages. A file's path counts from after its last ``/resources/``."""
    path = F.substring_index("path", "/resources/", -1)
    files = s.resources.where(F.contains("path", F.lit("/resources/"))).select(path.alias("resource")).distinct()
    stem = F.regexp_extract("resource", r"^(.*?)(_[^/]*)?\.properties$", 1)
    bundles = files.where(F.col("resource").endswith(".properties")).select(stem.alias("resource_path"), "resource").unionByName(files.where(F.col("resource").endswith(".properties")).select(F.regexp_replace("resource", r"\.properties$", "").alias("resource_path"), "resource")).distinct()
    used = s.resource_usages
    same = used.join(files.select(F.col("resource").alias("resource_path"), "resource"), "resource_path")
    family = used.where("kind = 'bundle'").join(bundles, "resource_path")
    return same.unionByName(family).select("class_id", "kind", "resource_path", "resource").distinct()


def unresolved_resources(s: Snapshot) -> DataFrame:
    """Usages that mean no file."""
    return s.resource_usages.join(resource_references(s).select("class_id", "resource_path"), ["class_id", "resource_path"], "left_anti").select("class_id", "kind", "resource_path")
