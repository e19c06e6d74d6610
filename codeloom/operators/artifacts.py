"""Artifacts on the class paths of modules: who has them, whether they declare them, and in which scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import distances

# Relations between modules that a test's class path follows first, and those that it follows from there.
TEST_FIRST, RUNTIME = ("compile", "runtime", "test", "provided"), ("compile", "runtime")


def effective_class_paths(captured: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, source_set, jar, group, artifact, version, evidence): the captured class paths (module, source_set, jar, group, artifact, version), and for
    modules of which no test class path is captured the JARs of the main class paths of the modules that their tests see: itself, one
    step over ``edges`` (module, visible, relation) that tests follow, then any number of runtime ones."""
    own = captured.select("module", "source_set", "jar", "group", "artifact", "version", F.lit("captured").alias("evidence")).distinct()
    main = own.where("source_set = 'main'")
    modules = captured.select("module").union(edges.select("module")).distinct()
    lacking = modules.join(own.where("source_set = 'test'").select("module"), "module", "left_anti")
    first = edges.where(F.col("relation").isin(*TEST_FIRST)).join(lacking, "module", "left_semi").select(F.col("module").alias("origin"), F.col("visible").alias("node"))
    onward = edges.where(F.col("relation").isin(*RUNTIME)).select(F.col("module").alias("src"), F.col("visible").alias("dst"))
    seen = distances(onward, first.distinct()).select("origin", "node").unionByName(lacking.select(F.col("module").alias("origin"), F.col("module").alias("node"))).distinct()
    inferred = seen.join(main.withColumnRenamed("module", "node"), "node").select(F.col("origin").alias("module"), F.lit("test").alias("source_set"), "jar", "group", "artifact", "version", F.lit("inferred").alias("evidence")).distinct()
    return own.unionByName(inferred)


def artifact_view(paths: DataFrame, declared: DataFrame, complete: DataFrame, *, module: str | None = None, source_set: str | None = None, query: str | None = None, group: str | None = None, artifact: str | None = None, scope: str | None = None, directness: str | None = None) -> DataFrame:
    """(coordinate, group, artifact, version, modules, direct, transitive, unknown, scopes, directness) of the artifacts on class paths (see
    :func:`effective_class_paths`): how many modules have it, declare it (``declared``: module, group, artifact, scope), have it through others (of the
    ``complete`` modules, whose declarations are all known), or may do either. ``directness`` is direct, transitive or unknown if all modules agree, else
    mixed; ``scopes`` are those of the declarations. Parts of names are compared without case."""
    rows = paths
    for column, value in (("module", module), ("source_set", source_set)):
        if value:
            rows = rows.where(F.col(column) == value)
    if query:
        rows = rows.where(F.lower(F.concat("group", F.lit(":"), "artifact", F.lit(":"), "version", F.lit(" "), F.substring_index("jar", "/", -1))).contains(query.strip().lower()))
    has = rows.select("group", "artifact", "version", "module").distinct()
    told = declared.groupBy("module", "group", "artifact").agg(F.collect_set("scope").alias("own_scopes")).withColumn("direct", F.lit(True))
    known = has.join(told, ["module", "group", "artifact"], "left").join(complete.select("module", F.lit(True).alias("complete")).distinct(), "module", "left")
    direct, whole = F.coalesce("direct", F.lit(False)), F.coalesce("complete", F.lit(False))
    by = known.groupBy("group", "artifact", "version").agg(F.count(F.lit(1)).alias("modules"), F.count_if(direct).alias("direct"), F.count_if(whole & ~direct).alias("transitive"), F.count_if(~whole).alias("unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own_scopes")))), ",").alias("scopes"))
    d, t, u = (F.col(c) > 0 for c in ("direct", "transitive", "unknown"))
    state = F.when(d & ~t & ~u, "direct").when(~d & t & ~u, "transitive").when(~d & ~t, "unknown").otherwise("mixed")
    found = by.select(F.concat_ws(":", "group", "artifact", "version").alias("coordinate"), "*", state.alias("directness"))
    for column, value in (("group", group), ("artifact", artifact)):
        if value:
            found = found.where(F.lower(column).contains(value.strip().lower()))
    if scope:
        found = found.where(F.array_contains(F.split(F.lower("scopes"), ","), scope.strip().lower()))
    return found.where(F.col("directness") == directness) if directness else found
