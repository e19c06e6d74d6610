"""Aggregates over the dependency, call and field graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import library_of, outer_name, package_name
from codeloom.plans.snapshot import Snapshot, is_current, is_production
from codeloom.runtime import by_shuffle


def edges_between_current(s: Snapshot, *columns: str) -> DataFrame:
    """Dependencies whose ends are both current, with the wanted class columns as ``from_*`` and ``to_*``."""
    side = lambda p: s.current().select(F.col("id").alias(f"{p}_class_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return s.dependencies.join(side("from"), "from_class_id").join(side("to"), "to_class_id")


def fan_metrics(s: Snapshot, targets: DataFrame | None = None) -> DataFrame:
    """Per current class (or only of ``targets``, id): distinct current classes that use it and that it uses, and summed occurrences. Edges are
    cut down to the targets before they are joined and counted."""
    wanted = lambda df, c: df if targets is None else df.join(targets.select(F.col("id").alias(c)), c, "left_semi")
    current = s.current().select("id")
    ends = lambda df, own, other: wanted(df, own).join(by_shuffle(current.select(F.col("id").alias(own))), own, "left_semi").join(by_shuffle(current.select(F.col("id").alias(other))), other, "left_semi")
    into = ends(s.dependencies, "to_class_id", "from_class_id").groupBy(F.col("to_class_id").alias("id")).agg(F.countDistinct("from_class_id").alias("fan_in"), F.sum("occurrence_count").alias("in_occurrences"))
    out = ends(s.dependencies, "from_class_id", "to_class_id").groupBy(F.col("from_class_id").alias("id")).agg(F.countDistinct("to_class_id").alias("fan_out"), F.sum("occurrence_count").alias("out_occurrences"))
    whole = wanted(s.current().select("id", "class_name"), "id").join(into, "id", "left").join(out, "id", "left")
    return whole.select("id", "class_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "in_occurrences", "out_occurrences")])


def dependency_breakdown(s: Snapshot) -> DataFrame:
    """Inbound users by their origin, for each class: distinct classes and occurrences."""
    edges = s.dependencies.join(s.current().select(F.col("id").alias("from_class_id"), "origin"), "from_class_id")
    return edges.groupBy("to_class_id", "origin").agg(F.countDistinct("from_class_id").alias("classes"), F.sum("occurrence_count").alias("occurrences"))


def architecture_hubs(s: Snapshot, *, limit: int | None = None) -> DataFrame:
    """Distinct users of each class: all, source, generated, production and test; most used first."""
    users = s.current().select(F.col("id").alias("from_class_id"), "origin", "source_set")
    edges = s.dependencies.join(users, "from_class_id").join(s.current().select(F.col("id").alias("to_class_id"), "class_name"), "to_class_id")
    # each user once, so that the five counts are plain ones
    pairs = edges.select(F.col("to_class_id").alias("id"), "class_name", "from_class_id", "origin", "source_set").distinct()
    hubs = pairs.groupBy("id", "class_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("origin") == "source").alias("source"),
        F.count_if(F.col("origin") == "generated").alias("generated"),
        F.count_if(is_production()).alias("production"),
        F.count_if(F.col("source_set") == "test").alias("test"),
    )
    return hubs.orderBy(F.desc("total"), "id").limit(limit) if limit else hubs


def hub_rankings(s: Snapshot, *, top: int = 5) -> DataFrame:
    """The first classes of each of the five rankings of hubs."""
    hubs = architecture_hubs(s)
    long = hubs.unpivot(["id", "class_name"], ["total", "source", "generated", "production", "test"], "ranking", "users").where("users > 0")
    place = F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("users"), "id"))
    return long.withColumn("place", place).where(F.col("place") <= top).select("ranking", "place", "id", "class_name", "users")


def method_usage(s: Snapshot) -> DataFrame:
    """Distinct current caller classes and occurrences of each called method."""
    callers = s.current().select(F.col("id").alias("caller_class_id"))
    return s.method_calls.join(callers, "caller_class_id").groupBy("target_class_id", "target_method", "target_descriptor").agg(F.countDistinct("caller_class_id").alias("callers"), F.sum("occurrence_count").alias("occurrences"))


def field_usage(s: Snapshot) -> DataFrame:
    """Distinct current readers and writers of each field, and their accesses."""
    users = s.current().select(F.col("id").alias("accessor_class_id"))
    read = F.col("access_kind").startswith("read")
    total = lambda when: F.sum(F.when(when, F.col("occurrence_count")).otherwise(0))
    by_user = s.field_accesses.join(users, "accessor_class_id").groupBy("owner_class_id", "field_name", "accessor_class_id").agg(total(read).alias("reads"), total(~read).alias("writes"), F.max(read).alias("reader"), F.max(~read).alias("writer"))
    return by_user.groupBy("owner_class_id", "field_name").agg(F.count_if("reader").alias("readers"), F.count_if("writer").alias("writers"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))


def overview_counts(s: Snapshot) -> DataFrame:
    """(measure, value): classes, tokens, beans and commits, beans by scope and by kind."""
    long = lambda df, **of: df.agg(*[v.alias(k) for k, v in of.items()]).unpivot([], list(of), "measure", "value")
    parts = [
        long(s.current(), classes=F.count(F.lit(1)), source_tokens=F.coalesce(F.sum("source_tokens"), F.lit(0))),
        long(s.beans, beans=F.count(F.lit(1))),
        long(s.commits, commits=F.count(F.lit(1))),
        s.beans.groupBy(F.concat(F.lit("scope:"), "scope").alias("measure")).agg(F.count(F.lit(1)).alias("value")),
        s.beans.groupBy(F.concat(F.lit("kind:"), "kind").alias("measure")).agg(F.count(F.lit(1)).alias("value")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def external_libraries(s: Snapshot, *, limit: int = 20) -> DataFrame:
    """Libraries (the first two parts of a type's name) by distinct classes that use them. Names without a
    library take part in the limit and are left out after it."""
    by = s.external_deps.groupBy(library_of(F.col("external_type")).alias("library")).agg(F.countDistinct("class_id").alias("classes"))
    return by.orderBy(F.desc("classes"), "library").limit(limit).where("library <> ''")


def external_of_class(s: Snapshot) -> DataFrame:
    """External types by class and kind of use, in one list."""
    return s.external_deps.groupBy("class_id", "usage_kind").agg(F.array_join(F.array_sort(F.collect_set("external_type")), ",").alias("types"))


def classes_using_library(s: Snapshot, library: str, *, limit: int = 20) -> DataFrame:
    """Current classes that use a library."""
    used = s.external_deps.where(F.col("external_type").startswith(f"{library}.")).groupBy("class_id").agg(F.count(F.lit(1)).alias("uses"))
    return s.current().join(used, F.col("id") == F.col("class_id")).select("id", "class_name", "uses").orderBy("class_name").limit(limit)


def annotation_origin_counts(s: Snapshot, annotation: str) -> DataFrame:
    """Current classes with an annotation, by origin."""
    having = s.class_annotations.where(F.col("annotation_name") == annotation).select(F.col("class_id").alias("id"))
    return s.current().join(having, "id", "left_semi").groupBy("origin").agg(F.count(F.lit(1)).alias("classes"))


def resolve_annotation(s: Snapshot, name: str) -> DataFrame:
    """Annotation names equal to a name or ending in it after a dot, exact ones first."""
    names = s.class_annotations.select("annotation_name").distinct()
    exact = F.col("annotation_name") == name
    return names.where(exact | F.col("annotation_name").endswith(f".{name}")).select("annotation_name", exact.alias("exact")).orderBy(F.desc("exact"), "annotation_name")


def annotated_classes(s: Snapshot, annotation: str, *, include_meta: bool = True, limit: int | None = None) -> DataFrame:
    """Current classes with an annotation: direct if any of its rows is, else meta with the least annotation it comes by."""
    rows = s.class_annotations.where((F.col("annotation_name") == annotation) | F.col("annotation_name").endswith(f".{annotation}"))
    if not include_meta:
        rows = rows.where("direct")
    by = rows.groupBy(F.col("class_id").alias("id"), "annotation_name").agg(F.max("direct").alias("direct"), F.min(F.when(~F.col("direct"), F.col("via_annotation"))).alias("via"))
    found = s.current().join(by, "id").select("id", "class_name", "annotation_name", F.when(F.col("direct"), "direct").otherwise("meta").alias("match"), F.when(~F.col("direct"), F.col("via")).alias("via"))
    return found.orderBy("class_name", "annotation_name").limit(limit) if limit else found


def annotated_symbols(s: Snapshot, annotation: str) -> DataFrame:
    """Types and members with an annotation."""
    types = s.class_annotations.where(F.col("annotation_name") == annotation).select("class_id", F.lit("TYPE").alias("target"), F.lit(None).cast("string").alias("member")).distinct()
    members = s.class_members.where(F.array_contains(F.split("annotations", " "), annotation)).select("class_id", F.col("kind").alias("target"), F.concat("name", "descriptor").alias("member"))
    return types.unionByName(members)


def package_graph(s: Snapshot) -> DataFrame:
    """Per pair of different packages: dependency rows, occurrences, distinct class pairs, occurrences by kind."""
    edges = edges_between_current(s, "class_name").select(package_name(F.col("from_class_name")).alias("from_package"), package_name(F.col("to_class_name")).alias("to_package"), "from_class_id", "to_class_id", "kind", "occurrence_count").where("from_package <> to_package")
    kinds = edges.groupBy("from_package", "to_package", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("occurrence_count").alias("n"))
    summed = kinds.groupBy("from_package", "to_package").agg(F.sum("rows").alias("dependencies"), F.sum("n").alias("occurrences"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat(k["kind"], F.lit("="), k["n"])), ",").alias("kinds"))
    pairs = edges.groupBy("from_package", "to_package").agg(F.countDistinct("from_class_id", "to_class_id").alias("class_pairs"))
    return summed.join(pairs, ["from_package", "to_package"])


def package_summary(s: Snapshot) -> DataFrame:
    """Per package: classes, generated, tests, modules, tokens."""
    return s.current().groupBy(package_name(F.col("class_name")).alias("package")).agg(
        F.count(F.lit(1)).alias("classes"), F.count_if(F.col("origin") == "generated").alias("generated"), F.count_if(F.col("source_set") == "test").alias("tests"), F.countDistinct("module").alias("modules"), F.sum("source_tokens").alias("tokens")
    )


def collapsed_edges(s: Snapshot, *, module: str | None = None) -> DataFrame:
    """Dependencies between current classes (of a module), nested classes taken as their outermost one
    where that is among them; each pair once with its kinds. Pairs of one class drop out."""
    nodes = s.current() if module is None else s.current().where(F.col("module") == module)
    names = nodes.select("id", "class_name", outer_name(F.col("class_name")).alias("outer"))
    owners = names.select(F.col("class_name").alias("outer"), F.col("id").alias("owner"))
    place = names.join(by_shuffle(owners), "outer", "left").select("id", F.coalesce("owner", "id").alias("node"))
    ends = place.select(F.col("id").alias("from_class_id"), F.col("node").alias("src")), place.select(F.col("id").alias("to_class_id"), F.col("node").alias("dst"))
    edges = s.dependencies.join(by_shuffle(ends[0]), "from_class_id").join(by_shuffle(ends[1]), "to_class_id")
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def module_summaries(s: Snapshot) -> DataFrame:
    """Per module: classes, source, generated, tests, beans, tokens."""
    return s.current().groupBy("module").agg(
        F.count(F.lit(1)).alias("classes"), F.count_if(F.col("origin") == "source").alias("source"), F.count_if(F.col("origin") == "generated").alias("generated"),
        F.count_if(F.col("source_set") == "test").alias("tests"), F.count_if("is_bean").alias("beans"), F.sum("source_tokens").alias("tokens"),
    )


def ambiguous_occurrences(s: Snapshot) -> DataFrame:
    """Classes found in more than one output folder or module."""
    return s.class_occurrences.groupBy("class_id").agg(F.countDistinct("output_directory").alias("outputs"), F.countDistinct("module").alias("modules")).where("outputs > 1 OR modules > 1")


def coverage_scopes(s: Snapshot) -> DataFrame:
    """Current classes by module and source set; none is an empty text."""
    return s.current().groupBy(F.coalesce("module", F.lit("")).alias("module"), F.coalesce("source_set", F.lit("")).alias("source_set")).agg(F.count(F.lit(1)).alias("classes"))


def reference_caveats(s: Snapshot) -> DataFrame:
    """Per class what static usage can't cover: member handles that refer to it, dynamic calls that touch it."""
    handles = s.dependencies.where(F.col("kind").isin("METHOD_HANDLE_REFERENCE", "FIELD_HANDLE_REFERENCE")).groupBy(F.col("to_class_id").alias("id")).agg(F.count(F.lit(1)).alias("handles"))
    calls = s.method_calls.where(F.col("invocation_kind") == "dynamic")
    touched = calls.select(F.explode(F.array_distinct(F.array("caller_class_id", "target_class_id"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("calls"))
    return handles.join(touched, "id", "full").select("id", F.coalesce("handles", F.lit(0)).alias("handles"), F.coalesce("calls", F.lit(0)).alias("calls"))


def sole_anchors(s: Snapshot) -> DataFrame:
    """The least source path of each module, and whether it is the module's only one."""
    return s.current().where(F.col("module").isNotNull()).groupBy("module").agg(F.min("source_file").alias("path"), (F.countDistinct("source_file") == 1).alias("sole"))


def member_usage_of_consumers(s: Snapshot) -> DataFrame:
    """Per consuming module and source set and called method: groups of calls and their occurrences, over current callers."""
    callers = s.current().select(F.col("id").alias("caller_class_id"), "module", F.coalesce("source_set", F.lit("main")).alias("source_set"))
    return s.method_calls.join(callers, "caller_class_id").groupBy("module", "source_set", "target_class_id", "target_method", "target_descriptor").agg(F.count(F.lit(1)).alias("groups"), F.sum("occurrence_count").alias("occurrences"))


def injection_problem_counts(resolution: DataFrame) -> DataFrame:
    """Injection points by status."""
    return resolution.groupBy("status").agg(F.count(F.lit(1)).alias("points"))


def external_bean_artifacts(s: Snapshot) -> DataFrame:
    """Beans of dependencies by artifact; beans without a known artifact aren't listed."""
    return s.external_beans.where("artifact is not null").groupBy("artifact").agg(F.count(F.lit(1)).alias("beans"))


def required_configuration(s: Snapshot) -> DataFrame:
    """(key, bean, member): settings that beans of dependencies need."""
    beans = s.external_beans.select(F.col("id").alias("bean_id"), F.col("class_name").alias("bean"))
    return s.external_bean_settings.where("key is not null AND required").join(beans, "bean_id").select("key", "bean", "member")


def external_bean_summary(s: Snapshot) -> DataFrame:
    """One row: beans of dependencies, those with settings, and settings that are required or have a default."""
    known = s.external_bean_settings.where("key is not null").join(s.external_beans.select(F.col("id").alias("bean_id"), "class_name"), "bean_id")
    settings = known.agg(F.countDistinct("class_name").alias("beans_with_configuration"), F.count_if("required").alias("required"), F.count_if(~F.col("required")).alias("defaulted"))
    return s.external_beans.agg(F.count(F.lit(1)).alias("beans")).withColumn("one", F.lit(1)).join(settings.withColumn("one", F.lit(1)), "one").drop("one")


def annotated_places(s: Snapshot, annotation: str, *, meta: bool = True) -> DataFrame:
    """(class_id, class_name, kind, name, descriptor, position, match, via): every place in current classes that has an annotation: the class, a member, or a
    parameter (kind PARAMETER and its position from 0). ``match`` is direct, or meta where an annotation of the place (``via``, the first by name) has
    it, directly or through others; a place that has it directly isn't meta."""
    from codeloom.operators.graph import distances

    start = s.spark.createDataFrame([(annotation,)], "node string")
    on = s.annotation_metas.select(F.col("meta").alias("src"), F.col("annotation").alias("dst")).distinct()
    reach = distances(on, start, max_depth=None if meta else 0).select(F.col("node").alias("annotation"), (F.col("depth") > 0).alias("meta"))
    place = ["class_id", "name", "descriptor", "position"]
    found = s.annotation_uses.select(*place, "annotation").distinct().join(reach, "annotation").groupBy(*place).agg(F.min("meta").alias("meta"), F.min(F.when(F.col("meta"), F.col("annotation"))).alias("via"))
    kinds = s.class_members.select("class_id", "name", "descriptor", "kind").distinct()
    kind = F.when(F.col("position").isNotNull(), "PARAMETER").when(F.col("name") == "", "CLASS").otherwise(F.col("kind"))
    rows = found.join(kinds, ["class_id", "name", "descriptor"], "left").join(s.current().select(F.col("id").alias("class_id"), "class_name"), "class_id")
    return rows.select("class_id", "class_name", kind.alias("kind"), "name", "descriptor", "position", F.when(F.col("meta"), "meta").otherwise("direct").alias("match"), F.when(F.col("meta"), F.col("via")).alias("via"))
